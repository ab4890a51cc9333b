"""Traces through a property graph, for many queries at once: walks by level with caps, paths scored and chosen.

A walk's level is one join of all queries' frontiers with the adjacency. What a node claims depends on what those before it
claimed, so the choice itself is made query by query, while the rows of a partition stream by in order: of a node's
neighbours only as many go there as could be claimed by it and by those before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import graph, seeds
from cairnwork.operators.discovery import impact_scores, relation_score, text_score, trace_terms, trace_test_path
from cairnwork.plans.storage import cut

#: Which neighbours a walk takes first.
BETWEEN_STACKS, CALLS = ("calls-endpoint", "handled-by", "publishes", "consumes", "reads-config"), ("calls", "possible-calls")
#: Relations that say where something is and not what it does; kinds of places that are merely read.
CONTEXT = ("contains", "defines", "imports")
READ_PLACES = ("parameter", "local", "local-variable", "variable")
#: Marks of diagnostics in a node's path or name, words of a query that asks for tests.
DIAGNOSTICS = ("/logging/", "/observability/", "logger", "telemetry", "metrics")
TEST_WORDS = ("test", "tests", "spec", "fixture", "benchmark")


def plain_relation(relation: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(relation)), "^possible-", "")


def is_context(relation: Column) -> Column:
    return plain_relation(relation).isin(*CONTEXT)


def adjacency(nodes: DataFrame, edges: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(key, next, relation, direction, place, nth): each node's neighbours among `nodes`, between stacks first, then calls.

    place numbers a node's edges, nth its different neighbours.
    """
    e = edges.select("src", "dst", "relation").distinct()
    if relations:
        e = e.filter(F.col("relation").isin(relations))
    sides = []
    if direction != "incoming":
        sides.append(e.select(F.col("src").alias("key"), F.col("dst").alias("next"), "relation", F.lit("outgoing").alias("direction")))
    if direction != "outgoing":
        sides.append(e.select(F.col("dst").alias("key"), F.col("src").alias("next"), "relation", F.lit("incoming").alias("direction")))
    known = nodes.select(F.col("key").alias("next")).distinct()
    rows = reduce(DataFrame.unionByName, sides).join(known, "next", "left_semi")
    first = F.when(F.col("relation").isin(*BETWEEN_STACKS), 0).when(F.col("relation").isin(*CALLS), 1).otherwise(2)
    order = [first, "next", "direction", "relation"]
    rows = rows.withColumns({"place": F.row_number().over(W.partitionBy("key").orderBy(*order)), "again": F.row_number().over(W.partitionBy("key", "next").orderBy(*order)) > 1})
    return rows.withColumn("nth", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(W.partitionBy("key").orderBy("place")))


def _begun(starts: DataFrame) -> DataFrame:
    """starts (query, key, place) as walks without a step; of a node that is named twice the first counts."""
    firsts = starts.groupBy("query", "key").agg(F.min("place").alias("place"))
    place = F.row_number().over(W.partitionBy("query").orderBy("place", "key")) - 1
    none = F.array().cast("array<string>")
    return firsts.select("query", "key", place.cast("int").alias("place"), F.array("key").alias("nodes"), none.alias("relations"), none.alias("directions"))


def _longer(walks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The walks that chosen (query, place, next, relation, direction) lead to."""
    step = chosen.join(walks.select("query", "place", "nodes", "relations", "directions"), ["query", "place"])
    return step.select(
        *[c for c in chosen.columns if c not in ("place", "relation", "direction", "next")], F.col("next").alias("key"),
        *(F.concat(F.col(many), F.array(one)).alias(many) for many, one in (("nodes", "next"), ("relations", "relation"), ("directions", "direction"))),
    )


def _behaves(relations: Column) -> Column:
    return F.exists(relations, lambda r: ~is_context(r))


CHOSEN = "next string, relation string, direction string, place int, result int, queued int, claimed boolean"
CHOSEN_TYPES = {"next": pa.string(), "relation": pa.string(), "direction": pa.string(), "place": pa.int32(), "result": pa.int32(), "queued": pa.int32(), "claimed": pa.bool_()}


def _chosen(rows: DataFrame, begin: Callable, more: dict[str, pa.DataType] | None = None) -> DataFrame:
    """What `begin()`, a function of one row that gives a chosen row or None, chooses from the rows of each query by place and rank.

    Queries are dealt over all tasks, however small they are, and many go through one call.
    """
    types = {**CHOSEN_TYPES, **(more or {})}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, take = None, None
        for batch in batches:
            names, kind, out = batch.schema.names, batch.schema.field("query").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if take is None or row[0] != query:
                    query, take = row[0], begin()
                found = take(*row[1:])
                if found:
                    out.append((query, *found))
            columns = list(zip(*out)) or [[]] * (1 + len(types))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types.values()), strict=True)], names=[names[0], *types])

    spark = rows.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query").sortWithinPartitions("query", "place", "rank")
    shape = ", ".join([f"query {dict(rows.dtypes)['query']}", CHOSEN, *(f"{c} {'boolean' if t == pa.bool_() else 'string'}" for c, t in (more or {}).items())])
    return dealt.mapInArrow(choose, shape)


def walked(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, limit: int, *, targets: DataFrame | None = None,
           direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(query, nth, nodes, relations, directions): the first `limit` paths of each query in breadth-first order.

    starts (query, key, place); targets (query, key). A node is taken once in a query, by the first that comes to it, and a
    node takes at most `branches` others; without targets a path counts if it does something, with targets if it ends in one.
    A query's queue holds at most `waiting` walks.
    """
    branches, waiting = (min(max(limit, 8), 16), min(max(limit * 8, 64), 512)) if targets is None else (64, 4096)
    beside = cut(adjacency(nodes, edges, direction, relations))
    asked = None if targets is None else targets.select("query", F.col("key").alias("next")).distinct().withColumn("target", F.lit(True))
    walks = cut(_begun(starts.join(nodes.select("key").distinct(), "key", "left_semi")))
    claimed, results = walks.select("query", "key"), None
    for level in range(1, depth + 1):
        last = level == depth
        sizes = walks.groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("here"))
        so_far = claimed.groupBy("query").agg(F.count(F.lit(1)).alias("n_claimed"))
        front = walks.join(sizes, "query").join(so_far, "query").withColumn("behaves", _behaves(F.col("relations")))
        front = front.select("query", "key", "place", "here", "behaves", (F.col("n_claimed") + max(branches, limit) + branches * F.col("place")).alias("most"))
        steps = front.join(beside.withColumnRenamed("place", "rank"), "key")
        if asked is None:
            steps = steps.filter((F.col("nth") <= F.col("most")) & (F.lit(last) | ~F.col("again"))).withColumn("target", F.lit(False))
        else:
            steps = steps.join(asked, ["query", "next"], "left").withColumn("target", F.col("target").isNotNull())
            steps = steps.filter(F.col("target") | (F.col("nth") <= F.col("most")) & ~F.col("again") & F.lit(not last))
        steps = steps.join(claimed.withColumnRenamed("key", "next"), ["query", "next"], "left_anti")
        counts = F.col("target") if asked is not None else F.col("behaves") | ~is_context(F.col("relation"))
        rows = steps.select("query", "place", "here", "rank", "next", "relation", "direction", "target", counts.alias("counts"))

        def begin() -> Callable:
            taken, now, own, found, queued = set(), None, 0, 0, 0

            def take(place, here, rank, next, relation, direction, target, counts):
                nonlocal now, own, found, queued
                if place != now:
                    now, own = place, 0
                if own >= branches or next in taken:
                    return None
                result, goes_on = -1, not target and not last
                if counts and found < limit:
                    result, found = found, found + 1
                enters = goes_on and here - place - 1 + queued < waiting
                out = (next, relation, direction, place, result, queued if enters else -1, goes_on) if result >= 0 or goes_on else None
                if goes_on:
                    taken.add(next)
                    queued, own = queued + enters, own + 1
                return out

            return take

        chosen = cut(_chosen(rows, begin))
        grown = cut(_longer(walks, chosen))
        new = grown.filter("result >= 0").select("query", F.lit(level).alias("level"), "result", "nodes", "relations", "directions")
        results = new if results is None else results.unionByName(new)
        done = results.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("query")
        claimed = claimed.unionByName(chosen.filter("claimed").select("query", F.col("next").alias("key")))
        walks = cut(grown.filter("queued >= 0").join(done, "query", "left_anti").select("query", "key", F.col("queued").alias("place"), "nodes", "relations", "directions"))
        if walks.isEmpty():
            break
    place = F.row_number().over(W.partitionBy("query").orderBy("level", "result"))
    numbered = results.withColumn("nth", place.cast("long")).filter(F.col("nth") <= limit)
    return numbered.select("query", "nth", "nodes", "relations", "directions")


def label(node: Column) -> Column:
    """What a node is called: its qualified name, else its name, its path, its kind."""
    return F.coalesce(*(F.when(node[c] != "", node[c]) for c in ("qualified_name", "name", "path")), node["kind"])


def place_score(path: Column) -> Column:
    p = F.lower(F.trim(path))
    return F.when(p.startswith("@builtin/") | p.startswith("@stdlib/"), -140).when(p.startswith("@external/"), -50).otherwise(0)


def node_score(node: Column, terms: Column) -> Column:
    value = F.lower(F.concat_ws(" ", node["name"], node["qualified_name"], node["path"], node["kind"]))
    return text_score(value, terms) + place_score(node["path"]) + F.when(trace_test_path(node["path"]), -120).otherwise(0)


def ranked_neighbours(beside: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """beside (query, key, next, relation, ...) with score and rank: which neighbours of a key suit the query (query, text) best.

    A strong relation, words of the query, of change and of behaviour in what the neighbour is called; no tests, nothing built in.
    """
    named = nodes.select(F.col("key").alias("next"), F.struct("key", "kind", "name", "path", "qualified_name").alias("node"))
    terms = queries.select("query", trace_terms(F.col("text")).alias("terms"))
    told = beside.join(named, "next").join(terms, "query").withColumn("score", relation_score(F.col("relation")) + node_score(F.col("node"), F.col("terms")))
    rank = F.row_number().over(W.partitionBy("query", "key").orderBy(F.desc("score"), "relation", label(F.col("node")), "next"))
    return told.withColumn("rank", rank.cast("long")).drop("node", "terms")


#: Impact looks at so many dependents for each that it shows, at most so many.
CANDIDATES, MOST_CANDIDATES = 4, 64


def impacted(starts: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, depth: int, limit: int) -> DataFrame:
    """(query, rank, key, depth, relation, score, truncated): what depends on the starts (query, key) of each query, best first.

    The nearest candidates, by depth and key, each with the relations by which it depends on a node one step nearer; of
    those that are called alike in the same place the best counts. One bitset search serves all queries.
    """
    most = min(MOST_CANDIDATES, max(limit, limit * CANDIDATES))
    steps = cut(edges.filter(F.col("relation").isin(*graph.IMPACT)).select(F.col("dst").alias("key"), F.col("src").alias("next"), "relation").distinct())
    places = cut(seeds.numbered(starts))
    told = seeds.told(seeds.reached(steps.select("key", "next"), places, depth), places).join(starts.select("query", F.col("key").alias("seed")), "seed")
    found = cut(told.groupBy("query", "key").agg(F.min("depth").alias("depth")))
    of_query = W.partitionBy("query")
    away = found.filter("depth > 0").withColumns({"nth": F.row_number().over(of_query.orderBy("depth", "key")), "n": F.count(F.lit(1)).over(of_query)})
    near = away.filter(F.col("nth") <= most).withColumnRenamed("key", "next")
    before = found.select("query", "key", (F.col("depth") + 1).alias("depth"))
    by = near.join(before, ["query", "depth"]).join(steps, ["key", "next"]).select("query", F.col("next").alias("key"), "depth", "relation", "n").distinct()
    held = by.join(nodes.select("key", "kind", "name", "path", "qualified_name"), "key").join(queries.select("query", "text"), "query")
    asks_tests = reduce(lambda a, b: a | b, [F.lower("text").contains(w) for w in TEST_WORDS])
    rows = impact_scores(held, trace_terms(F.col("text")), asks_tests)
    called = F.lower(F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), F.col("name")))
    alike = [F.lower("path"), called, F.lower("kind"), plain_relation(F.col("relation"))]
    tie = [F.lower("path"), called, F.lower("relation"), "key"]
    rows = rows.withColumn("of_alike", F.row_number().over(W.partitionBy("query", *alike).orderBy(F.desc("score"), *tie))).filter("of_alike = 1")
    rows = rows.withColumns({"rank": F.row_number().over(of_query.orderBy(F.desc("score"), "depth", *tie)).cast("long"), "kept": F.count(F.lit(1)).over(of_query)})
    return rows.filter(F.col("rank") <= limit).select("query", "rank", "key", "depth", "relation", "score", ((F.col("kept") > limit) | (F.col("n") > most)).alias("truncated"))


#: Walks are widened by few nodes a level: at most so many walks, branches of each, results of one entry, results in all.
FRONTIER, SPREAD, OF_ENTRY, MOST = 8, 2, 4, 32


def spread(starts: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, depth: int, limit: int, *,
           direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(query, nth, nodes, relations, directions): paths along the neighbours that suit the query (query, text) best.

    A level has at most FRONTIER walks of SPREAD branches; OF_ENTRY paths that do something count for an entry, and if there
    are none in all, those that say where something is.
    """
    most = min(2 * limit, MOST)
    beside = cut(adjacency(nodes, edges, direction, relations).select("key", "next", "relation", "direction"))
    named = nodes.select(F.col("key").alias("next"), F.struct("key", "kind", "name", "path", "qualified_name").alias("node"))
    terms = queries.select("query", trace_terms(F.col("text")).alias("terms"))
    walks = _begun(starts.join(nodes.select("key").distinct(), "key", "left_semi"))
    walks = cut(walks.join(named.select(F.col("next").alias("key"), label(F.col("node")).alias("entry")), "key"))
    claimed = walks.select("query", "key")
    results = None
    for level in range(1, depth + 1):
        last = level == depth
        front = walks.filter(F.col("place") < FRONTIER).withColumn("did", _behaves(F.col("relations"))).select("query", "key", "place", "did", "entry")
        steps = front.join(beside, "key").join(claimed.withColumnRenamed("key", "next"), ["query", "next"], "left_anti").join(named, "next").join(terms, "query")
        score = relation_score(F.col("relation")) + node_score(F.col("node"), F.col("terms"))
        steps = steps.withColumns({"score": score, "behaves": F.col("did") | ~is_context(F.col("relation")), "label": label(F.col("node"))})
        steps = steps.withColumn("entry", F.when(F.lit(level == 1) & is_context(F.col("relation")), F.col("label")).otherwise(F.col("entry")))
        best = [F.desc("score"), "relation", "label", "next", "direction"]
        steps = steps.withColumns({
            "rank": F.row_number().over(W.partitionBy("query", "place").orderBy(*best)),
            "of_kind": F.row_number().over(W.partitionBy("query", "place", "behaves").orderBy(*best)),
        }).filter(F.col("of_kind") <= MOST + 2 * FRONTIER * SPREAD)
        rows = steps.select("query", "place", "rank", "next", "relation", "direction", "behaves", "entry", F.lit(0).cast("long").alias("held"))
        if results is not None:  # what a query has so far comes before its rows, counted
            none = F.lit(None).cast("string")
            held = results.groupBy("query", "behaves", "entry").agg(F.count(F.lit(1)).alias("held"))
            rows = rows.unionByName(held.select("query", F.lit(-1).alias("place"), F.lit(0).alias("rank"), none.alias("next"), none.alias("relation"), none.alias("direction"), "behaves", "entry", "held"))

        def begin() -> Callable:
            of_entry, doing, idle = {}, 0, 0
            taken, now, own, found, queued, over = set(), None, 0, 0, 0, False

            def take(place, rank, next, relation, direction, behaves, entry, held):
                nonlocal doing, idle, now, own, found, queued, over
                called = entry.lower()
                if held:
                    doing, idle = (doing + held, idle) if behaves else (doing, idle + held)
                    if behaves:
                        of_entry[called] = of_entry.get(called, 0) + held
                    return None
                if place != now:
                    now, own = place, 0
                if over or own >= SPREAD or next in taken:
                    return None
                result = -1
                if behaves and of_entry.get(called, 0) < OF_ENTRY:
                    of_entry[called] = of_entry.get(called, 0) + 1
                    doing, result, found = doing + 1, found, found + 1
                elif not behaves and idle < most:
                    idle, result, found = idle + 1, found, found + 1
                if last:
                    return (next, relation, direction, place, result, -1, False, behaves, entry) if result >= 0 else None
                out = (next, relation, direction, place, result, queued, True, behaves, entry)
                taken.add(next)
                queued, own = queued + 1, own + 1
                over = doing >= most or queued >= FRONTIER
                return out

            return take

        chosen = cut(_chosen(rows, begin, {"behaves": pa.bool_(), "entry": pa.string()}))
        grown = cut(_longer(walks, chosen))
        new = grown.filter("result >= 0").select("query", F.lit(level).alias("level"), "result", "nodes", "relations", "directions", "behaves", "entry")
        results = new if results is None else results.unionByName(new)
        done = results.groupBy("query").agg(F.sum(F.col("behaves").cast("int")).alias("n")).filter(F.col("n") >= most).select("query")
        claimed = claimed.unionByName(chosen.filter("claimed").select("query", F.col("next").alias("key")))
        walks = cut(grown.filter("queued >= 0").join(done, "query", "left_anti").select("query", "key", F.col("queued").alias("place"), "nodes", "relations", "directions", "entry"))
        if walks.isEmpty():
            break
    some = F.max("behaves").over(W.partitionBy("query"))
    kept = results.withColumn("some", some).filter(F.col("behaves") == F.col("some"))
    place = F.row_number().over(W.partitionBy("query").orderBy("level", "result")).cast("long")
    return kept.withColumn("nth", place).filter(F.col("nth") <= limit).select("query", "nth", "nodes", "relations", "directions")


def described(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths (query, nth, nodes, relations, ...) with `along`, the nodes themselves (key, kind, name, path, qualified_name)."""
    held = nodes.select(F.col("key").alias("node_key"), F.struct("key", "kind", "name", "path", "qualified_name").alias("node"))
    at = paths.select("query", "nth", F.posexplode("nodes").alias("i", "node_key")).join(held, "node_key")
    along = at.groupBy("query", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("along"))
    return paths.join(along, ["query", "nth"])


def scored(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """Described paths with score, summary, signature, entry, and what the choice among them asks for."""
    context = F.transform("relations", is_context)
    steps = F.size("relations")
    begins = F.coalesce(F.nullif(F.array_position(context, False), F.lit(0)) - 1, steps).cast("int")
    p = paths.join(queries.select("query", F.col("text").alias("asked")), "query").withColumns({"begins": begins, "terms": trace_terms(F.col("asked"))})
    start, later = F.element_at("along", F.col("begins") + 1), F.slice("along", F.col("begins") + 2, F.size("along"))
    last = F.element_at("along", -1)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    relations = total(F.transform("relations", lambda r, i: F.when(is_context(r), 0.0).otherwise(relation_score(r) * F.when(i == F.col("begins"), 0.7).otherwise(0.4))))
    diagnostic = F.exists(later, lambda n: reduce(lambda a, b: a | b, [F.lower(F.concat_ws(" ", n["path"], n["qualified_name"])).contains(x) for x in DIAGNOSTICS]))
    starts_in_test = trace_test_path(start["path"])
    behaves = _behaves(F.col("relations"))
    reads = (plain_relation(F.element_at("relations", -1)) == "reads") & F.lower(last["kind"]).isin(*READ_PLACES)
    score = (
        node_score(start, F.col("terms")) * 5.0 + relations + total(F.transform(later, lambda n: node_score(n, F.col("terms")) * 0.25))
        - F.when(diagnostic, 60).otherwise(0) - F.when(~starts_in_test & F.exists(later, lambda n: trace_test_path(n["path"])), 160).otherwise(0)
        - F.when(reads, 70).otherwise(0) - F.when(~behaves, 100).otherwise(0) - (steps - F.col("begins")) * 2
    )
    said = F.concat(
        F.when(F.col("begins") > 0, F.concat(label(F.element_at("along", 1)), F.lit(" member "))).otherwise(""), label(start),
        F.array_join(F.transform(F.slice("relations", F.col("begins") + 1, steps), lambda r, i: F.concat(F.lit(" --"), r, F.lit("→ "), label(F.element_at(later, i + 1)))), ""),
    )
    signature = F.concat(F.lower(label(start)), F.array_join(
        F.transform(F.slice("relations", F.col("begins") + 1, steps), lambda r, i: F.concat(F.lit(">"), F.lower(r), F.lit(">|"), F.lower(label(F.element_at(later, i + 1))))), ""))
    asks_tests = reduce(lambda a, b: a | b, [F.lower("asked").contains(w) for w in TEST_WORDS])
    return p.withColumns({
        "score": F.round(score, 6), "summary": said, "signature": signature, "entry": F.lower(label(start)), "behaves": behaves,
        "has_test": F.exists("along", lambda n: trace_test_path(n["path"])), "starts_in_test": starts_in_test,
        "intrinsic": (steps == 1) & (place_score(last["path"]) <= -100), "asks_tests": asks_tests,
    }).drop("begins", "terms", "asked")


def chosen(paths: DataFrame, limit: int, to_target: bool = False) -> DataFrame:
    """The best of each query's scored paths with their rank: none alike, at most two of an entry, few that enter tests."""
    of_query = W.partitionBy("query")
    p = paths.withColumns({"some": F.max("behaves").over(of_query), "some_in_production": F.max(F.col("behaves") & ~F.col("has_test")).over(of_query)})
    p = p.filter(~(F.col("some_in_production") & ~F.col("asks_tests") & F.col("has_test") & ~F.col("starts_in_test")) & ~F.col("intrinsic") & (F.col("behaves") | ~F.col("some")))
    best = [F.desc("score"), F.size("relations"), "summary", "nth"]
    p = p.withColumn("alike", F.row_number().over(W.partitionBy("query", "signature").orderBy(*best))).filter("alike = 1")
    if not to_target:
        p = p.withColumn("of_entry", F.row_number().over(W.partitionBy("query", "entry").orderBy(*best))).filter("of_entry <= 2")
    return p.withColumn("rank", F.row_number().over(of_query.orderBy(*best)).cast("long")).filter(F.col("rank") <= limit)


def trace(starts: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, depth: int, limit: int, *,
          direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(query, rank, lane, score, summary, nodes, relations) of each query: walked paths, spread ones where they have too few entries."""
    wanted = max(1, min(2 * limit, 64))
    first = cut(walked(starts, nodes, edges, depth, wanted, direction=direction, relations=relations).withColumn("lane", F.lit("walked")))
    told = cut(scored(described(first, nodes), queries))
    enough = told.filter("behaves").groupBy("query").agg(F.countDistinct("entry").alias("n")).filter(F.col("n") >= limit).select("query")
    few = starts.join(enough, "query", "left_anti")
    more = spread(few, nodes, edges, queries, depth, wanted, direction=direction, relations=relations).withColumn("lane", F.lit("spread"))
    more = scored(described(more, nodes), queries).withColumn("nth", F.col("nth") + wanted)
    return chosen(told.unionByName(more), limit).select("query", "rank", "lane", "score", "summary", "nodes", "relations")
