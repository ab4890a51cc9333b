"""Exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; 0 where lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def unit(v: Column, dims: int) -> Column:
    """The first dims elements at length one; null where too short, not finite or all zero."""
    cut = F.slice(v, 1, dims)
    norm = F.sqrt(dot(cut, cut))
    good = (F.size(v) >= dims) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(good, F.transform(cut, lambda x: x.cast("double") / norm))


def cache_key(*parts: Column) -> Column:
    """One digest for what a vector was made of: model, dimensions, purpose, text; null counts as empty."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def _blocks(rows: DataFrame, id_: str, v: str, block: int) -> DataFrame:
    """(ids, sizes, data): up to `block` rows of a partition in one, their elements one after another as doubles; a null vector has the size -1."""
    kind = dict(rows.dtypes)[id_]

    def pack(batches):
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, vs = zip(*held, strict=True)
            held.clear()
            sizes = [-1 if x is None else len(x) for x in vs]
            data = np.array([y for x in vs for y in x or ()], np.float64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(id_kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["ids", "sizes", "data"])

        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.append(row)
                if len(held) == block:
                    yield out()
        if held:
            yield out()

    narrow = rows.select(F.col(id_).alias("id"), F.col(v).cast("array<double>").alias("v"))
    id_kind = narrow.select("id").limit(0).toArrow().schema.field("id").type
    return narrow.mapInArrow(pack, f"ids array<{kind}>, sizes array<int>, data binary")


def _matrices(sizes: np.ndarray, data: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which rows have it, and their matrix."""
    flat, ends = np.frombuffer(data, np.float64), np.cumsum(np.maximum(sizes, 0))
    rows = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist() if n >= 0}
    return {n: (at, flat[(ends[at] - n)[:, None] + np.arange(n)]) for n, at in rows.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score, rank) by inner product to six digits, ties by id.

    Vectors: (vec_id, v). Queries: (query_id, q), a stated set. Blocks of vectors meet blocks of queries, a product of two
    matrices each, of which the best k of every query go on with all that tie with the last of them.
    """
    kinds = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["query_id"]
    vs = _blocks(vectors, "vec_id", "v", block)
    qs = _blocks(queries, "query_id", "q", block).withColumnsRenamed({"ids": "q_ids", "sizes": "q_sizes", "data": "q_data"})
    types = [df.select(c).limit(0).toArrow().schema.field(c).type for df, c in ((queries, "query_id"), (vectors, "vec_id"))]

    def best(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in ("ids", "sizes", "data", "q_ids", "q_sizes", "q_data")}
                n, m = len(one["q_ids"]), len(one["ids"])
                scores = np.zeros((n, m))
                of_q, of_v = (_matrices(one[s].values.to_numpy(), one[d].as_py()) for s, d in (("q_sizes", "q_data"), ("sizes", "data")))
                for size in of_q.keys() & of_v.keys():
                    scores[np.ix_(of_q[size][0], of_v[size][0])] = of_q[size][1] @ of_v[size][1].T
                rounded = np.round(scores, 6)
                last = np.partition(rounded, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
                at, to = np.nonzero(~(rounded < last[:, None]))
                yield pa.RecordBatch.from_arrays([one["q_ids"].values.take(pa.array(at)), one["ids"].values.take(pa.array(to)), pa.array(scores[at, to])], schema=shape)

    shape = pa.schema([("query_id", types[0]), ("vec_id", types[1]), ("score", pa.float64())])
    met = vs.crossJoin(qs).mapInArrow(best, f"query_id {kinds[1]}, vec_id {kinds[0]}, score double").withColumn("score", F.round("score", 6))
    here = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", here.cast("long")).filter(F.col("rank") <= k)


def windows(queries: DataFrame, size: int = 16, mode: str = "fast", most: int = 0) -> DataFrame:
    """(query_id, part, label, tokens) of queries (query_id, tokens): what is embedded for each query.

    fast: windows of `size` tokens; full: the whole query; quality: the whole, then the windows, unless there is just one.
    most > 0 cuts a query to that many tokens first. Queries without tokens have no parts.
    """
    if mode not in ("fast", "full", "quality") or size <= 0 or most < 0:
        raise ValueError("mode is fast, full or quality; size is positive; most is not negative")
    q = queries.select("query_id", (F.slice("tokens", 1, most) if most else F.col("tokens")).alias("tokens")).filter(F.size("tokens") > 0)
    n = F.ceil(F.size("tokens") / size).cast("int")
    whole = F.struct(F.lit("full query").alias("label"), F.col("tokens"))
    split = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("split window "), i.cast("string"), F.lit("/"), n.cast("string")).alias("label"), F.slice("tokens", (i - 1) * size + 1, F.lit(size)).alias("tokens")))
    parts = {"fast": split, "full": F.array(whole), "quality": F.when(n == 1, F.array(whole)).otherwise(F.concat(F.array(whole), split))}[mode]
    return q.select("query_id", F.posexplode(parts).alias("part", "p")).select("query_id", "part", "p.label", "p.tokens")


def nearest_to_parts(vectors: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of parts (query_id, part, q): a vector's score is the greatest of a query's parts.

    The best k of the greatest scores are among the best k of some part, so each part keeps only its own.
    """
    numbered = parts.select(F.struct("query_id", "part").alias("query"), "q").withColumn("query_id", F.to_json("query"))
    names = numbered.select("query_id", F.col("query.query_id").alias("of"))
    met = nearest(vectors, numbered.select("query_id", "q"), k).join(names, "query_id").groupBy("of", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("of").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).withColumnRenamed("of", "query_id")
