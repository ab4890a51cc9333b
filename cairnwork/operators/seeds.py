"""What a graph says of many seeds at once: roles, dependents, gaps, and the chains between seeds of one query.

Seeds are numbered, and a search carries, for each node, the seeds that have reached it as bits of 64-bit words: a level is
one join and one OR for all seeds, and a hub is one row for 64 of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import graph
from cairnwork.plans.storage import cut

#: How much is told: dependents and gaps of a seed, relationships of a role, seeds of a query that chains are sought between.
DEPENDENTS, GAPS, RELATIONSHIPS, CHAINED = 12, 8, 16, 3
IMPACT_DEPTH, CHAIN_DEPTH = 4, 8


def numbered(seeds: DataFrame) -> DataFrame:
    """(key, word, bit): a place among the bits for each different key of seeds, from counts of ranges of keys."""
    keys = graph.compiled(seeds.select("key").distinct())
    return keys.select("key", F.floor(F.col("node_id") / 64).alias("word"), (F.col("node_id") % 64).cast("int").alias("bit"))


def reached(steps: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """(key, word, bits, depth): which seeds come to a node in `depth` steps at least, seeds themselves at 0.

    steps (key, next); places (key, word, bit).
    """
    steps = cut(steps.select("key", "next").distinct())
    front = cut(places.groupBy("key", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    found, seen = front.withColumn("depth", F.lit(0)), front
    for level in range(1, depth + 1):
        moved = front.join(steps, "key").groupBy(F.col("next").alias("key"), "word").agg(F.bit_or("bits").alias("come"))
        fresh = moved.join(seen, ["key", "word"], "left").select("key", "word", F.col("come").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits"))
        front = cut(fresh.filter("bits <> 0"))
        if front.isEmpty():
            break
        found = found.unionByName(front.withColumn("depth", F.lit(level)))
        seen = cut(seen.unionByName(front).groupBy("key", "word").agg(F.bit_or("bits").alias("bits")))
    return found


def told(found: DataFrame, places: DataFrame) -> DataFrame:
    """(seed, key, depth) of what was reached."""
    bits = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1) = 1)")
    rows = found.select("key", "word", "depth", F.explode(bits).alias("bit"))
    return rows.join(places.withColumnRenamed("key", "seed"), ["word", "bit"]).select("seed", "key", "depth")


def dependents(edges: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH, limit: int = DEPENDENTS) -> DataFrame:
    """(seed, nth, key, depth, truncated): those that depend on each seed, the nearest first, at most `limit`."""
    places = cut(numbered(seeds))
    back = edges.filter(F.col("relation").isin(*graph.IMPACT)).select(F.col("dst").alias("key"), F.col("src").alias("next"))
    rows = told(reached(back, places, depth).filter("depth > 0"), places)
    of_seed = W.partitionBy("seed")
    rows = rows.withColumns({"nth": F.row_number().over(of_seed.orderBy("depth", "key")), "n": F.count(F.lit(1)).over(of_seed)})
    return rows.filter(F.col("nth") <= limit).select("seed", F.col("nth").cast("long").alias("nth"), "key", "depth", (F.col("n") > limit).alias("truncated"))


def roles(edges: DataFrame, seeds: DataFrame, most: int = RELATIONSHIPS) -> DataFrame:
    """(seed, nth, direction, key, relation, truncated): callers, then callees, by key and relation, at most `most`."""
    e = graph.call_edges(edges).distinct()
    keys = seeds.select(F.col("key").alias("seed")).distinct()
    into = e.join(keys, e["dst"] == keys["seed"]).select("seed", F.lit("incoming").alias("direction"), F.col("src").alias("key"), "relation")
    out = e.join(keys, e["src"] == keys["seed"]).select("seed", F.lit("outgoing").alias("direction"), F.col("dst").alias("key"), "relation")
    of_seed = W.partitionBy("seed")
    rows = into.unionByName(out).withColumns({"nth": F.row_number().over(of_seed.orderBy("direction", "key", "relation")), "n": F.count(F.lit(1)).over(of_seed)})
    return rows.filter(F.col("nth") <= most).select("seed", F.col("nth").cast("long").alias("nth"), "direction", "key", "relation", (F.col("n") > most).alias("truncated"))


def gaps(unresolved: DataFrame, seeds: DataFrame, limit: int = GAPS) -> DataFrame:
    """(seed, nth, relation, expression, reason, truncated) of unresolved (source, relation, expression, reason)."""
    rows = unresolved.join(seeds.select(F.col("key").alias("source")).distinct(), "source").withColumnRenamed("source", "seed")
    of_seed = W.partitionBy("seed")
    rows = rows.withColumns({"nth": F.row_number().over(of_seed.orderBy("relation", "expression", "reason")), "n": F.count(F.lit(1)).over(of_seed)})
    return rows.filter(F.col("nth") <= limit).select("seed", F.col("nth").cast("long").alias("nth"), "relation", "expression", "reason", (F.col("n") > limit).alias("truncated"))


def chains(edges: DataFrame, pairs: DataFrame, depth: int = CHAIN_DEPTH) -> DataFrame:
    """(start, target, nodes, relations): the shortest call chain of each pair (start, target), of those the first by its nodes.

    Pairs are numbered and searched from both ends, half the depth each, so that what is reached grows with the square
    root of a whole search. Of the nodes where the halves of a shortest chain meet the way back to the start is marked;
    then each chain takes the least node that is one step nearer, one join a step for all pairs.
    """
    steps = cut(graph.call_edges(edges).groupBy(F.col("src").alias("key"), F.col("dst").alias("next")).agg(F.min("relation").alias("relation")))
    pairs = pairs.filter("start <> target").distinct()
    # pairs of one start, and of one target as far as keys are alike, share words
    places = cut(numbered(pairs.select(F.struct("start", "target").alias("key"))).select("key.*", "word", "bit"))
    ends = {who: places.select(F.col(who).alias("key"), "word", "bit") for who in ("start", "target")}
    ahead = cut(reached(steps.select("key", "next"), ends["start"], (depth + 1) // 2).withColumnRenamed("depth", "gone"))
    back = cut(reached(steps.select(F.col("next").alias("key"), F.col("key").alias("next")), ends["target"], depth // 2).withColumnRenamed("depth", "left"))
    both = ahead.withColumnRenamed("bits", "mine").join(back, ["key", "word"]).withColumn("bits", F.col("mine").bitwiseAND(F.col("bits"))).filter("bits <> 0")
    met = cut(both.select("key", "word", "bits", "gone", "left"))
    each = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1) = 1)")
    # a pair's distance is its least sum of two halves; of the sums that give it the last meeting on the way counts
    lengths = met.groupBy("word", "gone", "left").agg(F.bit_or("bits").alias("bits")).select("word", "gone", "left", F.explode(each).alias("bit")).groupBy("word", "bit").agg(F.min(F.struct((F.col("gone") + F.col("left")).alias("steps"), (-F.col("gone")).alias("gone"))).alias("m"))
    lengths = cut(lengths.select("word", "bit", F.col("m.steps").alias("steps"), (-F.col("m.gone")).alias("gone")))
    of_word = lengths.groupBy("word", "gone", (F.col("steps") - F.col("gone")).alias("left")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("own"))
    own = met.join(of_word, ["word", "gone", "left"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("own"))).filter("bits <> 0")
    own = cut(own.select("key", "word", "gone", "bits"))
    # (next, word, gone, bits): nodes of the first half that lie on a shortest chain of a pair
    lies = marked = own
    for gone in range((depth + 1) // 2, 1, -1):
        here = lies.filter(F.col("gone") == gone).select(F.col("key").alias("next"), "word", F.col("bits").alias("mine"))
        before = here.join(steps, "next").groupBy("key", "word").agg(F.bit_or("mine").alias("mine"))
        before = before.join(ahead.filter(F.col("gone") == gone - 1), ["key", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("mine"))).filter("bits <> 0")
        before = cut(before.select("key", "word", "gone", "bits"))
        marked = marked.unionByName(before)
        lies = own.unionByName(before)
    marked = cut(marked.groupBy(F.col("key").alias("next"), "word", F.col("gone").alias("at")).agg(F.bit_or("bits").alias("bits")))
    near = back.withColumnsRenamed({"key": "next"})
    none = F.array().cast("array<string>")
    at = cut(places.join(lengths, ["word", "bit"]).select("start", "target", "word", "bit", "steps", "gone", F.col("start").alias("key"), F.array("start").alias("nodes"), none.alias("relations")))
    done = None
    for n in range(1, depth + 1):
        moved = at.withColumns({"at": F.lit(n), "left": F.col("steps") - n}).join(steps, "key")
        first = moved.filter(F.col("at") <= F.col("gone")).join(marked, ["next", "word", "at"])
        second = moved.filter(F.col("at") > F.col("gone")).join(near, ["next", "word", "left"])
        nearer = first.select(*moved.columns, "bits").unionByName(second.select(*moved.columns, "bits")).filter("(shiftrightunsigned(bits, bit) & 1) = 1")
        best = nearer.groupBy("start", "target", "word", "bit", "steps", "gone").agg(F.min(F.struct("next", "relation", "nodes", "relations")).alias("b"))
        at = cut(best.select("start", "target", "word", "bit", "steps", "gone", F.col("b.next").alias("key"), F.concat("b.nodes", F.array("b.next")).alias("nodes"), F.concat("b.relations", F.array("b.relation")).alias("relations")))
        ended = at.filter(F.col("steps") == n).select("start", "target", "nodes", "relations")
        done = ended if done is None else done.unionByName(ended)
        at = at.filter(F.col("steps") > n)
        if at.isEmpty():
            break
    return done


def evidence(edges: DataFrame, unresolved: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query, place, kind, nth, label): what is told of the seeds (query, place, key) of each query, chains among its first CHAINED."""
    of = lambda rows, kind, label: seeds.join(rows.withColumnRenamed("seed", "key_of"), F.col("key") == F.col("key_of")).select("query", "place", F.lit(kind).alias("kind"), "nth", label.alias("label"))
    join = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    named = lambda rows: rows.withColumnRenamed("key", "other")
    first = seeds.filter(F.col("place") < CHAINED).select("query", "place", "key")
    pairs = first.join(first.select("query", F.col("place").alias("to"), F.col("key").alias("target")), "query").filter("place <> to").withColumnRenamed("key", "start")
    linked = pairs.join(chains(edges, pairs.select("start", "target")), ["start", "target"])
    said = F.concat_ws(">", F.element_at("nodes", 1), F.array_join(F.transform("relations", lambda r, i: F.concat_ws(">", r, F.get("nodes", i + 1))), ">"))
    return (
        of(named(roles(edges, seeds)), "operational_role", join("direction", "relation", "other"))
        .unionByName(of(named(dependents(edges, seeds)), "impact", join("depth", "other")))
        .unionByName(of(gaps(unresolved, seeds), "unresolved", join("relation", "expression", "reason")))
        .unionByName(linked.select("query", "place", F.lit("call_chain").alias("kind"), F.col("to").cast("long").alias("nth"), said.alias("label")))
    )
