"""A published lexical index: postings with all that BM25 needs, sorted by term, so that a search scans only its terms."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import retrieval
from cairnwork.plans.storage import shared_folder

#: Up to so many terms a search hands the scan as a filter that skips row groups; more are joined.
FILTERED = 512


@dataclass
class LexicalIndex:
    """postings: (term, doc_id, tf, dl, df); n documents and tokens in all."""

    postings: DataFrame
    n: int
    tokens: int

    def _gains(self, hits: DataFrame) -> DataFrame:
        """hits, postings with other columns, with the gain of each."""
        mean = self.tokens / self.n if self.n and self.tokens else 1.0
        k1, b = retrieval.K1, retrieval.B
        gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
        return hits.withColumn("gain", retrieval.idf(F.lit(self.n), F.col("df")) * gain)

    def gains(self, queries: DataFrame) -> DataFrame:
        """(doc_id, term, gain) of the postings of the terms of queries (query_id, term)."""
        return self._gains(self.postings.join(queries.select("term").distinct(), "term", "left_semi")).select("doc_id", "term", "gain")

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of every document with a term of a query; queries: (query_id, term)."""
        return retrieval.summed(self.gains(queries), queries, self.n)

    def search_terms(self, queries: dict[int, list[str]]) -> DataFrame:
        """search() for queries at hand: their terms reach the scan, which skips all row groups without one."""
        terms = sorted({t for ts in queries.values() for t in ts})
        pairs = sorted({(t, q) for q, ts in queries.items() for t in ts})
        asked = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.lit(q).cast("long") for u, q in pairs if u == t]))])
        if not terms or len(terms) > FILTERED:
            spark = self.postings.sparkSession
            return self.search(spark.createDataFrame([(q, t) for t, q in pairs], "query_id long, term string"))
        hits = self._gains(self._of(terms)).select("doc_id", "gain", F.explode(F.element_at(asked, F.col("term"))).alias("query_id"))
        return hits.groupBy("query_id", "doc_id").agg(F.sum("gain").alias("score"))

    def _of(self, terms: list[str]) -> DataFrame:
        """The postings of terms, at most FILTERED, as a filter that skips row groups."""
        return self.postings.filter(" OR ".join(["term = '" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms]) or "false")

    def holding(self, asked: DataFrame) -> DataFrame:
        """asked (term, ...) with doc_id: every document with that term."""
        few = [r["term"] for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
        some = self._of(few) if len(few) <= FILTERED else self.postings
        return some.select("term", "doc_id").join(asked, "term")


def build(docs: DataFrame, folder: str) -> None:
    """Write the index of docs (doc_id, text) below folder: postings sorted by term and document, and the totals.

    Ranges are of (term, doc_id), so that a term of a third of the documents is split over tasks.
    """
    spark = docs.sparkSession
    # terms stand with their document's others, so that its length takes no exchange
    tf = retrieval.term_frequencies(docs).withColumn("dl", F.sum("tf").over(W.partitionBy("doc_id")))
    tf.write.mode("errorifexists").parquet(f"{folder}/tf")
    tf = spark.read.parquet(f"{folder}/tf")
    joined = tf.join(retrieval.document_frequencies(tf), "term").select("term", "doc_id", "tf", "dl", "df")
    joined.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/postings")
    tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n"))).coalesce(1).write.parquet(f"{folder}/totals")


def read(spark: SparkSession, folder: str) -> LexicalIndex:
    totals = spark.read.parquet(f"{folder}/totals").first()
    return LexicalIndex(spark.read.parquet(f"{folder}/postings"), totals["n"], totals["tokens"])


_held: dict[tuple[str, str], LexicalIndex] = {}


def at_hand(spark: SparkSession, name: str, docs: Callable[[], DataFrame]) -> LexicalIndex:
    """The index of that name: built in the shared folder the first time an application asks, then only read."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _held:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        build(docs(), folder)
        _held[key] = read(spark, folder)
    return _held[key]
