"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].

1. One narrow scan gives each row the length of its normalised text and a hash of that text's prefix. Counts are
   taken first by length, then by (length, prefix hash) within lengths that occur twice. Both aggregate before the
   shuffle, so a hot group costs a row per task.
2. The (length, prefix hash) groups with two rows or more go into a bitmap, which is broadcast: 16 bits or more a group
   as there are at most half as many groups as rows, which are counted (Parquet's footers tell), up to 2^most_bits bits
   (64 MiB) whatever the input. A second scan computes the full hash only of rows that the bitmap lets through. Its false positives cost a hash, never a wrong answer.
3. Full hashes are grouped with (length, prefix hash), again with partial aggregation. Membership is joined back on
   salted keys, so that a group with a third of all rows is spread over `salts` tasks. Texts are never shuffled.

Cases: a null text counts as empty; all empty texts are equal. Of equal texts the row with the most code points in
the original text stays, then the smallest id; a null id comes last. Each input row gives one output row; rows that
repeat an id and text all carry keep_id = that id and so are all `kept`. An empty table gives an empty table. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _keys(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("raw"))
    rows = rows.select("id", F.length("raw").cast("long").alias("n_points"), F.xxhash64("raw").alias("text_key"), normalised(F.col("raw")).alias("norm"))
    return rows.withColumns({
        "n_norm": F.length("norm").cast("long"),
        "prefix_hash": F.xxhash64(F.substring("norm", 1, prefix)),
    })


def _surviving_groups(keys: DataFrame) -> DataFrame:
    """(length, prefix hash) groups of two rows or more, refined from lengths of two rows or more."""
    pairs = keys.groupBy("n_norm", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    lengths = keys.groupBy("n_norm").agg(F.count(F.lit(1)).alias("of_length")).filter("of_length > 1").select("n_norm")
    return pairs.join(lengths, "n_norm", "left_semi").filter("n > 1").select("n_norm", "prefix_hash")


def _bitmap(groups: DataFrame, bits: int) -> DataFrame:
    """At most 2^bits / 32768 rows of 4 KiB."""
    slot = _slot(bits)
    return (
        groups.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("n_norm", "prefix_hash"), F.lit(1 << bits)) + F.lit(1)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    prefix: int = 64, least_bits: int = 20, most_bits: int = 29, salts: int = 32, digest_all: bool = False,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256, text_key (xxhash64 of the text, null as empty).

    text_sha256 is the SHA-256 of the normalised text; without digest_all it is null for rows that the refinement
    showed to be unique before their full content was read.
    """
    keys = _keys(docs, id_col, text_col, prefix)
    bits = min(most_bits, max(least_bits, (8 * docs.count()).bit_length()))  # a group has two rows or more
    bitmap = F.broadcast(_bitmap(_surviving_groups(keys.drop("norm")), bits))
    slot = _slot(bits)
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(F.col("bit"), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    through = F.coalesce(F.expr("shiftright(byte, cast(bit % 8 as int)) & 1") == 1, F.lit(False))
    rows = (
        keys.withColumns({"bucket": F.bitmap_bucket_number(slot), "bit": F.bitmap_bit_position(slot)})
        .join(bitmap, "bucket", "left")
        .withColumn("byte", byte)
        .withColumn("through", through)
    )
    full = F.sha2(F.encode("norm", "UTF-8"), 256)
    rows = rows.select(
        "id", "text_key", "n_points", "n_norm", "prefix_hash", "through",
        (full if digest_all else F.when(F.col("through"), full)).alias("full_hash"),
    )
    group = ["n_norm", "prefix_hash", "full_hash"]
    best = F.min(F.struct((-F.col("n_points")).alias("longest"), F.col("id").isNull().alias("unknown"), "id"))
    groups = (
        rows.filter("through").groupBy(*group).agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
        .filter("size > 1")
        .select(*group, "size", F.col("best.id").alias("best_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, [*group, "salt"], "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("full_hash").alias("text_sha256"), "text_key",
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, digest_all=True).drop("text_key")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n_points, doc_id)) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
