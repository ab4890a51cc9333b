"""Spelling variants by anagram hashing: words that differ by one letter, and the most common form of each.

1. Words are counted over all texts. A word's anagram key is the sum of the fifth powers of its letters' code points, so
   that a letter more or less, or exchanged, moves the key by a value that depends on the letters alone.
2. Two words differ by such a value if and only if their keys meet once each word has given up one letter (exchange) or the
   longer one alone has (addition, removal). So every word is listed under its own key and under its key less each of its
   letters: length + 2 rows at most, not one for every pair of letters in the alphabet, and never more than twice the
   alphabet. Keys meet in one equi-join, and an integer for each stands for it.
3. Anagrams share a key, and where words are made of the same parts there are very many. A letter lies in the first or in
   the second half of what is left, so the other half is the same in both words: a hash of it goes with the key, a row a
   half. What meets differs only in how the letters of half a word are ordered, and no key gathers all anagrams.
4. Letter order is verified on the words: just one edit. If the edit lies in the middle and both halves would report a pair,
   only the first does, so every pair is met once and needs no distinct.
5. A word's form is its most frequent near word if that is `ratio` times as frequent. As counts grow by that ratio with each
   step, the greatest count bounds how long a chain of forms is, and doubling reaches its end in a few joins.

Hot words are counted with partial aggregation. How many rows a word has is bounded by its alphabet, and how many near words
by its length and the alphabet, whatever the corpus.

Cases: a null text has no words. A null id stands for an empty one in the choice of the letter to delete. Repeated rows
count again. Words of any length are taken whole. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common
from cairnwork.llm.resampling import CRC_TABLE, LOWER, UPPER, crc_sql

RUN = r"[A-Za-zÀ-ÿ]{%d,}"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word, n: lower-cased runs of letters, one letter deleted where `every` divides the run's hash (0: nowhere)."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # a run that is shorter gives no word that is long enough, so only longer ones leave the text
    runs = F.transform(F.regexp_extract_all("text", F.lit(RUN % least_length), F.lit(0)), lambda r: F.translate(r, UPPER, LOWER))
    word = F.col("run")
    occurrences = rows.select("id", F.explode(runs).alias("run"))
    if every:
        h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        occurrences = occurrences.withColumn("h", h)
        word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    counted = occurrences.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def power(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def _half(word: Column, letters: Column, first: Column) -> Column:
    """The first floor(letters / 2) letters, or as many of the last as are left."""
    p = F.floor(letters / 2).cast("int")
    return F.when(first, F.substring(word, F.lit(1), p)).otherwise(F.substring(word, F.length(word) - (letters - p) + 1, letters - p))


def keyed(words: DataFrame) -> DataFrame:
    """word, n, first (which half is the same), key: the keys under which a word meets those near it."""
    size = F.length("word")
    letters = F.transform(F.split("word", ""), lambda c: c)
    total = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + power(c))
    # a letter of the second half leaves the first as it is
    given_up = F.array_distinct(F.transform(letters, lambda c, i: F.struct(c.alias("letter"), (i >= F.floor((size - 1) / 2)).alias("first"))))
    whole = F.array(*[F.struct(F.lit("").alias("letter"), F.lit(x).alias("first")) for x in (True, False)])
    rows = words.select("word", "n", total.alias("total"), F.explode(F.concat(whole, given_up)).alias("less"))
    left = F.when(F.col("less.letter") == "", size).otherwise(size - 1)
    moved = F.col("total") - F.when(F.col("less.letter") == "", 0).otherwise(power(F.col("less.letter")))
    same = _half(F.col("word"), F.col("left"), F.col("first"))
    return (
        rows.select("word", "n", F.col("less.first").alias("first"), left.alias("left"), moved.alias("moved"))
        .select("word", "n", "first", F.xxhash64("moved", "left", "first", same).alias("key"))
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: pairs of words, a before b, that differ by one inserted, deleted or replaced letter; each once."""
    rows = keyed(words.repartition(common.shuffle_partitions(words.sparkSession), "word"))  # a short table that becomes a long one
    a = rows.select("key", "first", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select("key", F.col("first").alias("first_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    # the key implies the half; with it both sides have the same columns, and one exchange serves both
    met = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("first") == F.col("first_b")) & (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    near = F.levenshtein("a", "b", 1) == 1
    left = F.when(F.length("a") == F.length("b"), F.length("a") - 1).otherwise(F.least(F.length("a"), F.length("b")))
    p = F.floor(left / 2).cast("int")
    also_first = F.substring("a", F.lit(1), p) == F.substring("b", F.lit(1), p)
    return met.filter(near & (F.col("first") | ~also_first)).select("a", "n_a", "b", "n_b")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word in `words` (word, n; one row a word); ratio is 2 or more."""
    if ratio < 2:
        raise ValueError("with a ratio under 2 two words could be each other's form")
    words = common.materialize(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    side = F.explode(F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("less"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("less"), F.col("a").alias("other")),
    )).alias("s")
    best = pairs.select(side).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    found = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    found = common.materialize(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
        ), "spelling-forms",
    )
    steps = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest, most = 0, found.agg(F.max("form_n")).first()[0] or 1
    while most >= ratio:
        longest, most = longest + 1, most // ratio
    for _ in range(longest.bit_length()):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps = common.materialize(steps, "spelling-roots")
    return found.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(count_words(common.table(spark, sf_dir, "documents")))


ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
hashed AS (SELECT run, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= 7),
results AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM words)),
pairs AS (
  SELECT l.word AS a, r.word AS b, r.n AS n_b FROM less l JOIN less r ON l.rest = r.rest AND l.p = r.p AND l.word <> r.word
  UNION SELECT l.word, r.word, r.n FROM less l JOIN words r ON l.rest = r.word
  UNION SELECT r.word, l.word, l.n FROM less l JOIN words r ON l.rest = r.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n_b, encode(b))) AS other, max(n_b) AS n_other FROM pairs GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN n_other >= 10 * n THEN other END AS form,
    CASE WHEN n_other >= 10 * n THEN n_other END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
