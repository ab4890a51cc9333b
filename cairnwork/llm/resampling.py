"""Importance resampling towards a target distribution of hashed word features, scored without exploding a document.

1. Features of a text are its runs of `ngrams` words; higher-order functions turn a text into the array of its
   features' buckets (crc32 modulo `buckets`). A text's words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z
   are lower-cased.
2. How often each bucket occurs in the corpus and in the target is counted with partial aggregation: one row a bucket
   and task is all that is shuffled, whatever bucket is hot. At most `buckets` counts reach the driver, which bounds
   the gain array.
3. The gains are one literal array. A document's weight is an aggregate over its bucket array, element_at giving each
   bucket's gain: documents are not exploded, joined or shuffled.
4. Gumbel noise from a hash of the id and `seed` makes the highest scores a draw without replacement in proportion to the
   weights. Ranks come from ranges of the score: how many rows each range has (one number a partition) gives the ranks
   that it begins with, and rows are numbered inside their range. Ranges past the draw are not sorted.

Cases: a null text has no features: weight 0, and as it has no words it is never drawn. A null id is hashed as an empty
one and comes last among ties. Repeated rows each have a rank of their own, in no fixed order among themselves. An empty
corpus gives an empty table; an empty target counts 0 in all buckets. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnwork.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features_of(words: Column, ngrams: tuple[int, int]) -> Column:
    """The runs of ngrams[0] to ngrams[1] consecutive words, joined by one space, with repeats."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    found = [runs(n) for n in range(ngrams[0], ngrams[1] + 1)]
    return F.concat(*found) if len(found) > 1 else found[0]


def bucketed(docs: DataFrame, text_col: str, ngrams: tuple[int, int], buckets: int) -> DataFrame:
    """docs with n_words and `hashed`, the array of its features' buckets."""
    return (
        docs.withColumn("words", words_of(F.col(text_col))).withColumn("n_words", F.size("words").cast("long"))
        .withColumn("hashed", F.transform(features_of(F.col("words"), ngrams), lambda f: F.pmod(F.crc32(F.encode(f, "UTF-8")), F.lit(buckets)).cast("int")))
        .drop("words")
    )


def bucket_counts(docs: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs."""
    counted = docs.select(F.explode("hashed").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = [0] * buckets
    for r in counted.collect():  # at most one row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the ratio of the buckets' smoothed shares in the target and in the corpus)."""
    n, all_corpus, all_target = len(corpus), sum(corpus), sum(target)
    return [floor(1000 * log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus, target, strict=True)]


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *,
    ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024,
) -> DataFrame:
    """id, n_words, n_features, weight, score of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    corpus = bucketed(rows, "text", ngrams, buckets)
    wanted = bucketed(target.select(F.col(f"`{target_text_col}`").alias("text")), "text", ngrams, buckets)
    gain = gains(bucket_counts(corpus, buckets), bucket_counts(wanted, buckets))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    weight = F.aggregate("hashed", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    made = corpus.select("id", "n_words", F.size("hashed").cast("long").alias("n_features"), weight.alias("weight"))
    return made.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def ranked(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """rows with their rank by score (then id) if they are among the first `percent` of the eligible ones, else null."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id")]
    n = rows.filter(eligible).count()
    drawn = percent * n // 100
    ranges = rows.filter(eligible).repartitionByRange(common.shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranges = common.materialize(ranges, "draw-ranges")
    sizes = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    cut = sum(b < drawn for b in before)
    first = F.split(F.lit(",".join(map(str, before[:cut]))), ",").cast("array<bigint>")
    place = F.element_at(first, F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    head = ranges.filter(F.col("part") < cut).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = ranges.filter(F.col("part") >= cut).drop("part").unionByName(rows.filter(~eligible)).withColumn("rank", F.lit(None).cast("long"))
    return (head.drop("part").unionByName(rest)) if cut else rest


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *,
    percent: int = 10, least_words: int = 20, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024,
) -> DataFrame:
    """One row per input row: id_col, n_words, n_features, weight, score, rank (null if not drawn)."""
    rows = scored(docs, target, id_col, text_col, target_text_col, ngrams=ngrams, buckets=buckets, seed=seed)
    return ranked(common.materialize(rows, "draw-scores"), F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc(list of bytes) as a common table expression: the reversed polynomial's table by its rule, then a fold over bytes.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i)) AS crc)"""


def crc_sql(text: str) -> str:
    """DuckDB's crc32 of a text's UTF-8; crc_table must be among the tables of the FROM clause."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(1, length({digits}), 2), lambda p: ('0x' || substr({digits}, p, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS word FROM d),
bw AS (SELECT unnest(words) AS word FROM b),
distinct_words AS (SELECT word FROM dw UNION SELECT word FROM bw),
hashed AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM distinct_words, crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000)) / ((s.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), total),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN places USING (doc_id)
"""
