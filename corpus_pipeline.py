"""A corpus from raw documents to packed sequences, each stage one operator of cairnwork.llm.

Every stage takes all that the one before kept. Stages but the last return the columns of documents:

1. language: documents whose language can't be told go: no text, no letters, or less than LEAST_COVERAGE of the n-grams
   known in any language; all others stay as they are, and so do all if there are no labels to learn from.
2. exact: of documents equal without white space one stays.
3. near: of each component of near-duplicates (five-word shingles, similarity of 0.8 or more) one document stays.
4. suffix: bytes in strings of PASSAGE_BYTES bytes that occur elsewhere are cut out; text and n_chars change, no row goes.
5. packing: sequences of at most 4096 tokens; one row a piece, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import common, exact_dedup, langid, minhash, packing, suffix_dedup

#: The least share of a text's n-grams, corrected for chance, that its language must know. Text in a language that was
#: learned has 0.5 or more, in another script next to nothing.
LEAST_COVERAGE = 0.1
#: What a passage of 50 words takes at least, at 4.8 bytes a word with its space: the stage cuts passages of over 50 words.
PASSAGE_BYTES = 240


def _only_kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that the decisions keep; of rows that repeat an id and text, one.

    A row goes by 64-bit hashes of its id and of its text, so that one exchange serves the join and the repeats.
    """
    keep = decisions.filter("kept").select(F.xxhash64("doc_id").alias("__k1"), F.col("text_key").alias("__k2")).distinct()
    keyed = docs.withColumns({"__k1": F.xxhash64("doc_id"), "__k2": F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(keep, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit_documents(docs)
    if not model.languages:
        return docs
    known = (F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE)
    return langid.predict(docs, model).filter(known).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only_kept(docs, exact_dedup.exact_groups(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only_kept(docs, minhash.near_duplicates(docs, words=5, percent=80))


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, with_text=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[columns.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("room")


STAGES = [("language", language), ("exact", exact), ("near", near), ("suffix", suffix), ("packing", packed)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
