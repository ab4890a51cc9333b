"""Property-graph operators over nodes (key, kind, name, path) and edges (src, dst, relation)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.plans.storage import cut

#: The relations that impact follows by default.
IMPACT = (
    "calls possible-calls passes-to observed-calls references calls-endpoint handled-by publishes consumes reads-config "
    "invokes-process produces-message consumes-message"
).split()


def compiled(nodes: DataFrame) -> DataFrame:
    """Nodes with dense ids in the order of their keys.

    Ids come from counts of key ranges, so that the numbering is no single task's work.
    """
    parts = nodes.repartitionByRange("key").sortWithinPartitions("key").withColumn("__part", F.spark_partition_id())
    parts = cut(parts)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__start"))
    place = F.row_number().over(W.partitionBy("__part").orderBy("key")) - 1
    return parts.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn("node_id", (F.col("__start") + F.col("__place")).cast("long")).drop("__part", "__place", "__start")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "relation"])


def degrees(edges: DataFrame) -> DataFrame:
    """(key, degree, centrality): both ends count, a loop twice; centrality saturates with the logarithm."""
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key")))
    counted = ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    return counted.withColumn("centrality", F.round(F.least(F.lit(1.0), F.log1p("degree") / F.log(F.lit(13.0))), 6))


def relation_counts(edges: DataFrame) -> DataFrame:
    """(key, direction, relation, n)"""
    out = edges.groupBy(F.col("src").alias("key"), "relation").agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit("out"))
    into = edges.groupBy(F.col("dst").alias("key"), "relation").agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def distances(edges: DataFrame, entries: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(key, depth) of every node within `depth` steps of entries (key), these at 0: one join a level, visited nodes left out.

    The distinct steps are written once and only read at each level; a hub's many steps are split where adaptive
    execution finds its key hot, and a level's nodes are made distinct before they are shuffled.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("key"), F.col(b).alias("next")).distinct())
    frontier = entries.select("key").distinct().withColumn("depth", F.lit(0).cast("long"))
    seen = frontier = cut(frontier)
    for level in range(1, depth + 1):
        reached = frontier.join(steps, "key").select(F.col("next").alias("key")).distinct()
        frontier = cut(reached.join(seen, "key", "left_anti").withColumn("depth", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(depends: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """(key, part): what is to be emitted again, the changed (key) and all that depend on them, and the context: what these depend on themselves."""
    emit = cut(distances(depends, changed, depth, reverse=True).select("key"))
    context = depends.join(emit.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key")).distinct().join(emit, "key", "left_anti")
    return emit.withColumn("part", F.lit("emit")).unionByName(context.withColumn("part", F.lit("context")))


def impact(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Dependents of start with their distance, start itself left out."""
    return distances(edges.filter(F.col("relation").isin(IMPACT)), start, depth, reverse=True).filter("depth > 0")


def dead(nodes: DataFrame, edges: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """Callable nodes that no entry reaches."""
    return nodes.filter(F.col("kind").isin("function", "method", "constructor")).join(distances(edges, entries, depth), "key", "left_anti")


def simple_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(path, depth): paths without a node twice, as keys joined by >, of 1 to depth steps."""
    steps = edges.select(F.col("src").alias("key"), F.col("dst").alias("next"), "relation").distinct()
    at = start.select("key", F.array("key").alias("visited"), F.col("key").alias("path"))
    out = None
    for level in range(1, depth + 1):
        at = at.join(steps, "key").filter(~F.array_contains("visited", F.col("next")))
        at = at.select(F.col("next").alias("key"), F.concat("visited", F.array("next")).alias("visited"), F.concat_ws(">", "path", "relation", "next").alias("path"))
        found = at.select("path", F.lit(level).cast("long").alias("depth"))
        out = found if out is None else out.unionByName(found)
    return out


#: Links that one task contracts at a time.
LINKS = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and of each the least node that these links connect it with."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # to the top of each tree
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of each node, by the links (node, root) of this task; of many nodes what some of the links tell."""
    links, rows, held = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    star = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["node", "root"])
    for batch in batches:
        links.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= LINKS:
            held = _roots(*(np.concatenate(c) for c in zip(held, *links)))
            links, rows = [], 0
            if len(held[0]) > 2 * LINKS:
                yield star()
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if links:
        held = _roots(*(np.concatenate(c) for c in zip(held, *links)))
    yield star()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(key, component): the smallest key that a node is connected with.

    Nodes are 64-bit hashes of their keys, which are looked over for collisions. Each task contracts its links to stars,
    a node and the least one that it is connected with there; a node's least root is its pointer, and the links of its
    other roots with that one are the next round's. As hashes order nodes at random, a part of the nodes goes in every
    round, and no group holds more than one row a task. Links that fit in one task are contracted there, which ends it.
    """
    linked = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    for seed in range(42, 50):
        of = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).filter("key IS NOT NULL")
        keys = cut(ends.distinct().select(of("key").alias("node"), "key"))
        if keys.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("keys collide")
    links = linked.select(of("src").alias("node"), of("dst").alias("root"))
    pointers: list[DataFrame] = []
    for _ in range(most_rounds):
        stars = links.mapInArrow(_stars, "node long, root long")
        least = F.min("root").over(W.partitionBy("node"))
        met = cut(stars.withColumn("least", least))
        pointers.append(met.select("node", F.col("least").alias("to")).distinct())
        links = cut(met.filter("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct())
        left = links.count()
        if not left:
            break
        links = links.repartition(math.ceil(left / LINKS))
    else:
        raise RuntimeError("components did not settle")
    labels = pointers.pop().select("node", F.col("to").alias("label"))
    while pointers:  # a pointer's end is a node of the next round, or was told of no other root
        ends = labels.select(F.col("node").alias("to"), "label")
        labels = cut(pointers.pop().join(ends, "to", "left").select("node", F.coalesce("label", "to").alias("label")))
    named = cut(keys.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label")))
    return named.join(named.groupBy("label").agg(F.min("key").alias("component")), "label").select("key", "component")


def overlay(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    key = ["src", "dst", "relation"]
    return base.select(*key).join(removed.select(*key), key, "left_anti").unionByName(added.select(*key))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, relation, change) of edges in one snapshot alone."""
    key = ["src", "dst", "relation"]
    a, b = before.select(*key).distinct().withColumn("old", F.lit(True)), after.select(*key).distinct().withColumn("new", F.lit(True))
    joined = a.join(b, key, "full_outer")
    return joined.filter("old IS NULL OR new IS NULL").select(*key, F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


def shared_neighbours(edges: DataFrame, least: int) -> DataFrame:
    """(a, b, n): pairs of sources with `least` targets or more in common.

    Sources are numbered, so that pairs are counted as numbers; only the pairs that stay take their names.
    """
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ids = cut(e.select("src").distinct().withColumn("id", F.monotonically_increasing_id()))
    held = e.join(ids, "src").select("id", "dst")
    pairs = held.select(F.col("id").alias("x"), "dst").join(held.select(F.col("id").alias("y"), "dst"), "dst").filter("x < y")
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    named = counted.join(ids.select(F.col("id").alias("x"), F.col("src").alias("s")), "x").join(ids.select(F.col("id").alias("y"), F.col("src").alias("t")), "y")
    return named.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "n")


def name_ranks(nodes: DataFrame, query: str) -> DataFrame:
    """(key, rank, fields) of nodes that the trimmed query names: 0 to 2 exact name, qualified name, path; 3 to 5 a prefix of these; 6 to 8 a part.

    ASCII case and the kind of slash do not matter; fields lists what matched; an empty query matches nothing.
    """
    plain = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    q = F.translate(plain(F.trim(F.lit(query))), "\\", "/")
    ranks = []
    for i, (name, value) in enumerate((("name", plain(F.col("name"))), ("qualified_name", plain(F.col("qualified_name"))), ("path", F.translate(plain(F.col("path")), "\\", "/")))):
        ranks.append((name, F.when(value == q, i).when(F.startswith(value, q), i + 3).when(F.contains(value, q), i + 6)))
    fields = F.array_compact(F.array(*[F.when(r.isNotNull(), name) for name, r in ranks]))
    found = nodes.filter(F.lit(query.strip() != "")).select("key", F.least(*[r for _, r in ranks]).cast("long").alias("rank"), fields.alias("fields"))
    return found.filter("rank IS NOT NULL")


#: Relations that cross stacks; they are followed first, then calls.
INTERSTACK = "calls-endpoint handled-by publishes consumes reads-config invokes-process produces-message consumes-message".split()


def adjacency(edges: DataFrame, key: str) -> DataFrame:
    """(relation, key, place): neighbours in the order that traces follow: between stacks, calls, others; then by key and relation."""
    met = edges.filter((F.col("src") == key) | (F.col("dst") == key)).select("relation", F.when(F.col("src") == key, F.col("dst")).otherwise(F.col("src")).alias("key"))
    first = F.when(F.col("relation").isin(INTERSTACK), 0).when(F.col("relation").isin("calls", "possible-calls", "observed-calls"), 1).otherwise(2)
    return met.withColumn("place", F.row_number().over(W.orderBy(first, "key", "relation")).cast("long"))


def impact_in_order(edges: DataFrame, starts: DataFrame, depth: int, limit: int) -> DataFrame:
    """(place, key, depth, relation): the first `limit` nodes that a queue finds from starts (key), which follows neighbours in adjacency order.

    Level by level: each node keeps the least trail of (class, key, relation) steps that reaches it, which is the order
    of the queue; once the limit is reached no further level is taken.
    """
    both = edges.select(F.col("src").alias("key"), F.col("dst").alias("next"), "relation").unionByName(edges.select(F.col("dst").alias("key"), F.col("src").alias("next"), "relation")).distinct()
    first = F.when(F.col("relation").isin(INTERSTACK), 0).when(F.col("relation").isin("calls", "possible-calls", "observed-calls"), 1).otherwise(2)
    steps = cut(both.groupBy("key", "next").agg(F.min(F.struct(first.alias("class"), F.col("next").alias("node"), "relation")).alias("step")))
    trail = "array<struct<class: int, node: string, relation: string>>"
    at = starts.select("key").distinct().select("key", F.array(F.struct(F.lit(0).alias("class"), F.col("key").alias("node"), F.lit("").alias("relation"))).cast(trail).alias("trail"))
    seen, found, n = cut(at.select("key")), None, 0
    for level in range(1, depth + 1):
        reached = at.join(steps, "key").select(F.col("next").alias("key"), F.concat("trail", F.array("step")).alias("trail"))
        at = cut(reached.groupBy("key").agg(F.min("trail").alias("trail")).join(seen, "key", "left_anti"))
        got = at.withColumn("depth", F.lit(level).cast("long"))
        found, seen, n = got if found is None else found.unionByName(got), seen.unionByName(at.select("key")), n + at.count()
        if n >= limit or at.isEmpty():
            break
    best = found.orderBy("depth", "trail").limit(limit)
    return best.select((F.row_number().over(W.orderBy("depth", "trail")) - 1).cast("long").alias("place"), "key", "depth", F.element_at("trail", -1)["relation"].alias("relation"))


#: Operations of the graph protocol.
OPERATIONS = (
    "capabilities search_nodes resolve_symbol resolve_file list_nodes export_graph neighbors paths reachability impact shortest_call_chain "
    "dead_symbols operational_role architecture_summary unresolved stats diff"
).split()


#: How near a relation brings two seeds.
NEARNESS = {1.0: "calls routes handles publishes subscribes implements overrides", 0.8: "reads writes passes_to inherits extends uses", 0.4: "contains declares owns belongs_to"}


def centrality_among(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, key, centrality): how closely each seed (query_id, key, base) is tied to a query's others, of the best.

    A relation between two counts by its kind, neighbours in common 0.15 each up to four, both times half plus the
    other's base. Seeds of a query are few (a bounded pool), so that pairs of them are too.
    """
    weight = F.when(F.lit(False), 0.0)
    for w, names in NEARNESS.items():
        weight = weight.when(F.lower(F.trim("relation")).isin(names.split()), w)
    both = edges.select(F.col("src").alias("key"), F.col("dst").alias("next"), "relation").unionByName(edges.select(F.col("dst").alias("key"), F.col("src").alias("next"), "relation"))
    mine = cut(both.join(seeds.select("key").distinct(), "key", "left_semi").withColumn("weight", weight.otherwise(0.6)).distinct())
    other = seeds.select("query_id", F.col("key").alias("next"), F.col("base").alias("anchor"))
    direct = seeds.select("query_id", "key").join(mine, "key").join(other, ["query_id", "next"]).filter("next <> key").select("query_id", "key", (F.col("weight") * (F.col("anchor") + 0.5)).alias("raw"))
    near = mine.select("key", "next").distinct()
    pairs = seeds.select("query_id", "key").join(near, "key").join(other.select("query_id", F.col("next").alias("o"), "anchor").join(near.withColumnRenamed("key", "o"), "o"), ["query_id", "next"]).filter("o <> key")
    shared = pairs.groupBy("query_id", "key", "o", "anchor").agg(F.count(F.lit(1)).alias("n")).select("query_id", "key", (F.least("n", F.lit(4)) * 0.15 * (F.col("anchor") + 0.5)).alias("raw"))
    raw = seeds.select("query_id", "key", F.lit(0.0).alias("raw")).unionByName(direct).unionByName(shared).groupBy("query_id", "key").agg(F.sum("raw").alias("raw"))
    best = F.max("raw").over(W.partitionBy("query_id"))
    return raw.select("query_id", "key", F.when(best > 0, F.col("raw") / best).otherwise(0.0).alias("centrality"))


DEFAULT_LIMIT, MOST_ROWS = 1000, 10_000


def bounded(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MOST_ROWS) -> int:
    return min(default if limit is None else limit, most)


def page(rows: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, dict]:
    """A page of rows in a total order, and its head: count, offset, returned, truncated, next_offset."""
    count, limit = rows.count(), bounded(limit)
    offset = min(offset, count)
    returned = max(0, min(limit, count - offset))
    more = offset + returned < count
    return rows.orderBy(*order).offset(offset).limit(limit), {"count": count, "offset": offset, "returned": returned, "truncated": more, "next_offset": offset + returned if more else None}


def resolve(nodes: DataFrame, name: str | None = None, kind: str | None = None, path: str | None = None, under: str | None = None) -> DataFrame:
    """Nodes of that exact name, kind, path, and at or below a path prefix: what is not given does not count."""
    for column, value in (("name", name), ("kind", kind), ("path", path)):
        if value is not None:
            nodes = nodes.filter(F.col(column) == value)
    return nodes if under is None else nodes.filter((F.col("path") == under) | F.col("path").startswith(under + "/"))


#: Relations that calls follow, all relations in their order.
CALL = "calls observed-calls calls-endpoint handled-by publishes consumes invokes-process produces-message consumes-message".split()
POSSIBLE = "possible-calls"


def call_edges(edges: DataFrame, possible: bool = True) -> DataFrame:
    return edges.filter(F.col("relation").isin(CALL + [POSSIBLE] * possible))


def paths(edges: DataFrame, start: str, target: str, depth: int, limit: int = 100) -> DataFrame:
    """(place, path, depth): the first `limit` simple paths from start to target of at most depth steps.

    In the order of a depth-first walk by (node, relation); parallel relations are different paths; one of length 0 if
    start is the target. Only nodes from which the target can be reached in the steps left are followed.
    """
    spark = edges.sparkSession
    steps = cut(edges.select(F.col("src").alias("key"), F.col("dst").alias("next"), "relation").distinct())
    left = distances(edges, spark.createDataFrame([(target,)], "key string"), depth, reverse=True).select(F.col("key").alias("next"), F.col("depth").alias("left"))
    left = cut(left)
    trail = "array<struct<node: string, relation: string>>"
    at = spark.createDataFrame([(start,)], "key string").select("key", F.array(F.struct(F.col("key").alias("node"), F.lit("").alias("relation"))).cast(trail).alias("trail"))
    found = at.filter(F.col("key") == target).select("trail")
    for level in range(1, depth + 1):
        near = F.broadcast(left.filter(F.col("left") <= depth - level)) if level == depth else left.filter(F.col("left") <= depth - level)
        at = at.filter(F.col("key") != target).join(steps, "key").filter(~F.exists("trail", lambda x: x["node"] == F.col("next"))).join(near, "next")
        at = cut(at.select(F.col("next").alias("key"), F.concat("trail", F.array(F.struct(F.col("next").alias("node"), "relation"))).alias("trail")))
        found = found.unionByName(at.filter(F.col("key") == target).select("trail"))
    best = found.orderBy("trail").limit(limit)
    shown = F.array_join(F.transform("trail", lambda x: F.when(x["relation"] == "", x["node"]).otherwise(F.concat_ws(">", x["relation"], x["node"]))), ">")
    return best.select((F.row_number().over(W.orderBy("trail")) - 1).cast("long").alias("place"), shown.alias("path"), (F.size("trail") - 1).cast("long").alias("depth"))


def shortest_chain(edges: DataFrame, starts: DataFrame, target: str, depth: int) -> DataFrame:
    """(start, path, depth): for each start (key) the shortest chain to target, of those the first by its nodes, then relations.

    Level by level; each node keeps, for each start, the least trail that reaches it, which is the one that a queue in
    the order of (node, relation) finds first. Targets that were reached and nodes from which the target is too far
    are not followed.
    """
    steps = cut(edges.groupBy(F.col("src").alias("key"), F.col("dst").alias("next")).agg(F.min("relation").alias("relation")))
    left = cut(distances(edges, edges.sparkSession.createDataFrame([(target,)], "key string"), depth, reverse=True))
    far = left.select(F.col("key").alias("next"), F.col("depth").alias("left"))
    starts = starts.select("key").distinct().join(left.select("key"), "key", "left_semi")
    at = cut(starts.select(F.col("key").alias("start"), "key", F.array("key").alias("nodes"), F.array().cast("array<string>").alias("relations")))
    found, seen = at.filter(F.col("key") == target), at.select("start", "key")
    at = at.filter(F.col("key") != target)
    for level in range(1, depth + 1):
        if at.isEmpty():
            break
        reached = at.join(steps, "key").join(far.filter(F.col("left") <= depth - level), "next")
        reached = reached.select("start", F.col("next").alias("key"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"))
        best = reached.groupBy("start", "key").agg(F.min(F.struct("nodes", "relations")).alias("t")).join(seen, ["start", "key"], "left_anti").select("start", "key", "t.nodes", "t.relations")
        best = cut(best)
        done = best.filter(F.col("key") == target)
        found, seen = found.unionByName(done), seen.unionByName(best.select("start", "key"))
        at = best.join(done.select("start"), "start", "left_anti")
    shown = F.array_join(F.transform("nodes", lambda x, i: F.when(i == 0, x).otherwise(F.concat_ws(">", F.try_element_at("relations", i), x))), ">")
    return found.select("start", shown.alias("path"), F.size("relations").cast("long").alias("depth"))


def operational_role(edges: DataFrame, key: str, entries: DataFrame, depth: int) -> DataFrame:
    """(section, label, n): counts of relations in and out, callers and callees, the shortest chain from an entry."""
    e = edges.distinct()
    out, into = e.filter(F.col("src") == key), e.filter(F.col("dst") == key)
    calls = F.col("relation").isin("calls", "possible-calls", "observed-calls")
    rows = [
        into.groupBy(F.lit("incoming").alias("section"), F.col("relation").alias("label")).agg(F.count(F.lit(1)).alias("n")),
        out.groupBy(F.lit("outgoing").alias("section"), F.col("relation").alias("label")).agg(F.count(F.lit(1)).alias("n")),
        into.filter(calls).groupBy(F.lit("caller").alias("section"), F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("n")),
        out.filter(calls).groupBy(F.lit("callee").alias("section"), F.col("dst").alias("label")).agg(F.count(F.lit(1)).alias("n")),
        shortest_chain(call_edges(edges), entries, key, depth).orderBy("depth", "start").limit(1).select(F.lit("entry chain").alias("section"), F.col("path").alias("label"), F.col("depth").alias("n")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])


def communities(nodes: DataFrame, edges: DataFrame, under: str | None = None, least: int = 2, representatives: int = 5) -> DataFrame:
    """(community, section, label, n): connected components of the nodes at or below a path, with what they are made of.

    Sections: nodes, edges, relation, incoming and outgoing (edges over the border of the selection, by relation),
    kind, path (of the parent folder), representative (label a key, n its degree, the highest first).
    """
    own = cut(resolve(nodes, under=under).select("key", "kind", "path"))
    e = cut(edges.distinct())
    keys = own.select("key")
    src_in, dst_in = keys.select(F.col("key").alias("src"), F.lit(True).alias("a")), keys.select(F.col("key").alias("dst"), F.lit(True).alias("b"))
    e = cut(e.join(src_in, "src", "left").join(dst_in, "dst", "left").filter("a OR b"))
    inside = e.filter("a AND b")
    labels = components(inside).withColumnRenamed("component", "community")
    member = cut(own.join(labels, "key", "left").withColumn("community", F.coalesce("community", "key")))
    big = member.groupBy("community").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least).select("community")
    member = cut(member.join(big, "community", "left_semi"))
    at = member.select("key", "community")
    edge = inside.join(at.withColumnRenamed("key", "src"), "src")
    over = e.filter("a IS NULL OR b IS NULL").select(F.coalesce(F.when(F.col("a"), F.col("src")), F.col("dst")).alias("key"), F.when(F.col("a"), "outgoing").otherwise("incoming").alias("section"), F.col("relation").alias("label"))
    count = F.count(F.lit(1)).alias("n")
    ends = edge.select("community", F.col("src").alias("key")).unionByName(edge.filter("src <> dst").select("community", F.col("dst").alias("key")))
    degree = member.select("community", "key").join(ends.groupBy("community", "key").agg(count), ["community", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = degree.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "key"))).filter(F.col("place") <= representatives)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*\z", "")).otherwise(".")
    rows = [
        member.groupBy("community", F.lit("nodes").alias("section"), F.lit("").alias("label")).agg(count),
        edge.groupBy("community", F.lit("edges").alias("section"), F.lit("").alias("label")).agg(count),
        edge.groupBy("community", F.lit("relation").alias("section"), F.col("relation").alias("label")).agg(count),
        over.join(at, "key").groupBy("community", "section", "label").agg(count),
        member.groupBy("community", F.lit("kind").alias("section"), F.col("kind").alias("label")).agg(count),
        member.groupBy("community", F.lit("path").alias("section"), parent.alias("label")).agg(count),
        top.select("community", F.lit("representative").alias("section"), F.col("key").alias("label"), "n"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def certainty(relation, resolution=None):
    """An edge's own resolution where it is definite or possible; else possible for possible-* relations."""
    plain = F.when(F.contains(relation, F.lit("possible")), "possible").otherwise("definite")
    return plain if resolution is None else F.when(resolution.isin("definite", "possible"), resolution).otherwise(plain)


def relationships(edges: DataFrame, seeds: DataFrame, sites: int = 3) -> DataFrame:
    """(seed, direction, relation, certainty, related, occurrences, sites, truncated) of seeds (key); edges: (src, dst, relation, site).

    The first distinct sites in order, at most `sites`: they are counted and cut before they are gathered.
    """
    one = edges.join(seeds.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("src").alias("seed"), F.lit("outgoing").alias("direction"), "relation", F.col("dst").alias("related"), "site")
    two = edges.join(seeds.select(F.col("key").alias("dst")), "dst", "left_semi").filter("src <> dst").select(F.col("dst").alias("seed"), F.lit("incoming").alias("direction"), "relation", F.col("src").alias("related"), "site")
    key = ["seed", "direction", "relation", "related"]
    counted = one.unionByName(two).groupBy(*key, "site").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("site").isNotNull(), F.row_number().over(W.partitionBy(*key, F.col("site").isNull()).orderBy("site")))
    placed = counted.withColumn("place", place)
    grouped = placed.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_list(F.when(F.col("place") <= sites, F.col("site")))).alias("sites"), F.coalesce(F.max("place") > sites, F.lit(False)).alias("truncated"))
    return grouped.withColumn("certainty", certainty(F.col("relation")))


def node_difference(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, change) between two snapshots (nodes, edges): added, removed, metadata_changed, relationship_changed.

    Nodes are compared by all their columns; relationships by the set of (target, relation) that a node has, folded to
    two order-free sums of hashes of the distinct edges, so that no node's edges are gathered.
    """
    (n0, e0), (n1, e1) = before, after
    facts = [c for c in n1.columns if c != "key"]
    def state(nodes: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
        d = edges.select("src", "dst", "relation").distinct().groupBy(F.col("src").alias("key")).agg(
            F.sum(F.xxhash64("dst", "relation").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64("relation", "dst").cast("decimal(20,0)")).alias("y"), F.count(F.lit(1)).alias("z"))
        out = nodes.select("key", F.struct(*facts).alias("f")).join(d, "key", "left")
        return out.select("key", F.col("f").alias(f"f{tag}"), F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in "xyz")).alias(f"e{tag}"))

    both = state(n0, e0, "0").join(state(n1, e1, "1"), "key", "full_outer")
    changes = F.array_compact(F.array(
        F.when(F.col("f0").isNull(), "added"), F.when(F.col("f1").isNull(), "removed"),
        F.when(F.col("f0").isNotNull() & F.col("f1").isNotNull() & (F.col("f0") != F.col("f1")), "metadata_changed"),
        F.when(F.col("f0").isNotNull() & F.col("f1").isNotNull() & (F.col("e0") != F.col("e1")), "relationship_changed"),
    ))
    return both.select("key", F.explode(changes).alias("change"))


def checked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, key, n): keys with different facts, and edge ends that are no node; empty for a sound graph."""
    facts = F.struct(*[c for c in nodes.columns if c != "key"])
    conflicts = nodes.groupBy("key").agg(F.count_distinct(facts).alias("n")).filter("n > 1").select(F.lit("conflict").alias("problem"), "key", "n")
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return conflicts.unionByName(ends.join(nodes.select("key"), "key", "left_anti").select(F.lit("missing").alias("problem"), "key", "n"))


def invalid_overlay(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(problem, src, dst, relation): removed edges that the base lacks, added ones that it has."""
    key = ["src", "dst", "relation"]
    gone = removed.select(*key).join(base.select(*key), key, "left_anti").select(F.lit("removed, not in base").alias("problem"), *key)
    return gone.unionByName(added.select(*key).join(base.select(*key), key, "left_semi").select(F.lit("added, in base").alias("problem"), *key))


#: An order-free checksum of rows, from sums that aggregate before they are shuffled.
CHECKSUM = ("count(1) AS n", "sum(crc32(concat_ws('\\0', src, dst, relation))) AS low", "sum(crc32(concat_ws('\\0', relation, dst, src))) AS high")


def checksum(edges: DataFrame) -> DataFrame:
    """(n, low, high): an order-free checksum of the distinct edges."""
    return edges.select("src", "dst", "relation").distinct().agg(*map(F.expr, CHECKSUM))


def export_page(nodes: DataFrame, edges: DataFrame, offset: int, limit: int, pinned: list[str]) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by key with the pinned ones, and the edges with both ends on it."""
    held, _ = page(nodes, ["key"], offset, limit)
    own = cut(held.unionByName(nodes.filter(F.col("key").isin(pinned))).dropDuplicates(["key"]))
    keys = own.select("key")
    return own, edges.distinct().join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")


def neighbours(edges: DataFrame, key: str, direction: str, relations: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(relation, key) in the order of (key, relation): of the first scanned edges, 16 for each wanted but 1024 to 16384, those of the relations."""
    limit = bounded(limit)
    here, there = ("src", "dst") if direction == "outgoing" else ("dst", "src")
    some = edges.filter(F.col(here) == key).select("relation", F.col(there).alias("key")).distinct().orderBy("key", "relation").limit(max(1024, min(16 * limit, 16384)))
    return (some.filter(F.col("relation").isin(relations)) if relations else some).orderBy("key", "relation").limit(limit)


def synthetic(spark, topology: str, nodes: int, edges: int, seed: int) -> DataFrame:
    """(source, target): about `edges` distinct edges without loops, made by hashes of their numbers, in any number of tasks.

    Topologies: modular (nine in ten within blocks of 64), entangled (any to any), hub (nine in ten from one node in a
    hundred), layered (to the next tenth), chain (to the next node, then any).
    """
    i = spark.range(edges).select("id", *(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(nodes)).alias(f"r{k}") for k in range(3)), F.pmod(F.xxhash64(F.lit(seed), F.lit("p"), "id"), F.lit(10)).alias("p"))
    local = F.least(F.floor(F.col("r0") / 64) * 64 + F.col("r1") % 64, F.lit(nodes - 1))
    source, target = {
        "modular": (F.col("r0"), F.when(F.col("p") > 0, local).otherwise(F.col("r1"))), "entangled": (F.col("r0"), F.col("r1")),
        "hub": (F.when(F.col("p") > 0, F.col("r0") % max(1, nodes // 100)).otherwise(F.col("r0")), F.col("r1")),
        "layered": (F.col("r0"), (F.floor(F.col("r0") / max(1, nodes // 10)) + 1) * max(1, nodes // 10) + F.col("r1") % max(1, nodes // 10)),
        "chain": (F.when(F.col("id") < nodes - 1, F.col("id")).otherwise(F.col("r0")), F.when(F.col("id") < nodes - 1, F.col("id") + 1).otherwise(F.col("r1"))),
    }[topology]
    return i.select(source.cast("long").alias("source"), target.cast("long").alias("target")).filter((F.col("source") != F.col("target")) & (F.col("target") < nodes)).distinct()


def mutated(graph: DataFrame, share: float, nodes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(removed, added) edges: about a share of the edges, chosen by hash, and as many new ones instead."""
    chosen = F.pmod(F.xxhash64(F.lit(seed), "source", "target"), F.lit(1_000_000)) < int(share * 1_000_000)
    removed = graph.filter(chosen)
    new = removed.select(F.col("source"), F.pmod(F.xxhash64(F.lit(seed + 1), "source", "target"), F.lit(nodes)).alias("target")).filter("source <> target").distinct()
    return removed, new.join(graph, ["source", "target"], "left_anti")
