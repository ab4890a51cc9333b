"""Retrieval and trace metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank): relevant: (query_id, doc_id); ratios of nothing are 0."""
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"))
    joined = total.join(hit, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def nearest_rank(values: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank (ceil), one column a share."""
    sized = values.withColumns({
        "__n": F.count(F.lit(1)).over(W.partitionBy(group)), "__i": F.row_number().over(W.partitionBy(group).orderBy(value)),
    })
    return sized.groupBy(group).agg(*[F.max(F.when(F.col("__i") == F.ceil(F.col("__n") * p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


def repeated_inputs(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, repeated, tokens): text given again in a run counts as repeated; tokens are ceil(bytes / 4)."""
    again = F.row_number().over(W.partitionBy("conv_id", "text").orderBy("turn")) > 1
    return turns.withColumn("again", again).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if("again").alias("repeated"), F.sum(F.ceil(F.octet_length("text") / 4)).cast("long").alias("tokens"),
    )


def cases(results: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """One row a case of results (case_id, doc_id, rank) and expected (case_id, doc_id, role): required, supporting, forbidden.

    recall of the required ones, at each k too; mrr of the first relevant one; irrelevant rate; passed if nothing
    required is missing and nothing forbidden there. Ratios of nothing are 0.
    """
    flags = expected.groupBy("case_id", "doc_id").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in ("required", "supporting", "forbidden")))
    met = flags.join(results, ["case_id", "doc_id"], "full_outer").fillna(0, ["required", "supporting", "forbidden"])
    got, c = F.col("rank").isNotNull(), F.col
    relevant = (c("required") == 1) | (c("supporting") == 1)
    out = met.groupBy("case_id").agg(
        F.count_if(got).alias("results"), F.sum("required").alias("wanted"), F.count_if(got & (c("required") == 1)).alias("found"), F.count_if(got & ~relevant).alias("irrelevant"),
        F.count_if(got & (c("forbidden") == 1)).alias("forbidden"), F.min(F.when(relevant, c("rank"))).alias("first"), *(F.count_if((c("required") == 1) & (c("rank") <= k)).alias(f"at_{k}") for k in ks),
    )
    share = lambda a, b: F.round(F.coalesce(F.when(b != 0, a / b), F.lit(0.0)), 6)
    return out.select(
        "case_id", share(c("found"), c("wanted")).alias("recall"), *(share(c(f"at_{k}"), c("wanted")).alias(f"recall_{k}") for k in ks), F.round(F.coalesce(1 / c("first"), F.lit(0.0)), 6).alias("mrr"),
        share(c("irrelevant"), c("results")).alias("irrelevant_rate"), ((c("found") == c("wanted")) & (c("forbidden") == 0)).alias("passed"),
    )


def paired(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(measure, base, other, delta): means of two modes over rows (mode, measure, value)."""
    means = rows.filter(F.col("mode").isin(base, other)).groupBy("measure").agg(*(F.round(F.avg(F.when(F.col("mode") == m, F.col("value"))), 6).alias(n) for m, n in ((base, "base"), (other, "other"))))
    return means.withColumn("delta", F.round(F.col("other") - F.col("base"), 6))


def summaries(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, least, median, most): the median by nearest rank."""
    sized = samples.withColumns({"__n": F.count(F.lit(1)).over(W.partitionBy(group)), "__i": F.row_number().over(W.partitionBy(group).orderBy(value))})
    middle = F.max(F.when(F.col("__i") == F.ceil(F.col("__n") / 2), F.col(value)))
    return sized.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), middle.alias("median"), F.max(value).alias("most"))
