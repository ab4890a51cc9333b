"""Fact streams: reading, checking, owners, replacement of changed files, call sites, reports, runtime evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: about how many pairs of routes one task tries.
PAIRS = 32_000_000
SPAN = "struct<path: string, start_line: int, start_column: int, end_line: int, end_column: int>"
FACT = (
    f"record string, id string, kind string, name string, path string, qualified_name string, content_id string, owner string, span {SPAN}, "
    "attributes string, source string, target string, relation string, expression string, reason string, candidate_name string, "
    "schema_version int, adapter_version string, language string, repository string, mode string, changed_files array<string>, removed_files array<string>"
)


def parsed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FACT records of JSON lines with `at`, their order: file, block of the file, line. A line that is no JSON is an error."""
    lines = spark.read.text(paths).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value",
    )
    return lines.filter("trim(value) <> ''").select("at", F.from_json("value", FACT, {"mode": "FAILFAST"}).alias("r")).select("at", "r.*")


def read_facts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved): of nodes of one id the last line counts; edges need both ends named, not that these exist."""
    rows = parsed(spark, paths)
    node = F.max_by(F.struct("kind", "name", "path", "qualified_name", "content_id", "owner", "span", "attributes"), "at")
    nodes = rows.filter("record = 'node' AND id <> ''").groupBy("id").agg(node.alias("n")).select("id", "n.*")
    edges = rows.filter("record = 'edge' AND source <> '' AND target <> ''").select("source", "target", "relation", "owner", "span", "attributes")
    return nodes, edges, rows.filter("record = 'unresolved'").select("source", "relation", "expression", "reason", "candidate_name", "owner", "span")


def span_key(span: Column) -> Column:
    return F.struct(*[F.coalesce(span[c], F.lit(0 if c != "path" else "")).alias(c) for c in ("path", "start_line", "start_column", "end_line", "end_column")])


def problems(rows: DataFrame) -> DataFrame:
    """(problem, what): what is wrong with one stream of parsed() records; empty for a sound one.

    Header: version 1, the three names, a known mode. Records: known kinds, ids of sha256, normalised paths, spans that
    do not end before they start, ids once. A full stream's edges and unresolved references have known ends. Records
    stand in order. Only a pair of neighbours is looked at for the order, and references are anti-joins.
    """
    fact = rows.filter(F.col("record").isin("node", "edge", "unresolved"))
    head = rows.filter(~F.col("record").isin("node", "edge", "unresolved"))
    bad_path = lambda c: c.isNull() | (c == "") | c.contains("\\") | c.startswith("/") | F.exists(F.split(c, "/"), lambda x: x.isin(".", ".."))
    bad_id = lambda c: c.isNull() | ~c.rlike("^sha256:[0-9a-f]{64}$")
    s = F.col("span")
    late = F.struct(s["end_line"], s["end_column"]) < F.struct(s["start_line"], s["start_column"])
    small = F.least(*[F.coalesce(s[c], F.lit(0)) for c in ("start_line", "start_column", "end_line", "end_column")]) < 1
    rules = [
        (head, "header", (F.col("schema_version") != 1) | F.col("adapter_version").isNull() | F.col("language").isNull() | F.col("repository").isNull() | ~F.coalesce("mode", F.lit("full")).isin("full", "incremental"), F.col("record")),
        (fact.filter("record = 'node'"), "node id", bad_id(F.col("id")), F.col("id")), (fact.filter("record = 'node'"), "node path", bad_path(F.col("path")), F.col("id")),
        (fact.filter("record = 'node'"), "node names", F.col("name").isNull() | F.col("qualified_name").isNull() | F.col("kind").isNull(), F.col("id")),
        (fact.filter("record = 'edge'"), "edge ends", bad_id(F.col("source")) | bad_id(F.col("target")) | F.col("relation").isNull(), F.col("source")),
        (fact.filter("record = 'unresolved'"), "unresolved", bad_id(F.col("source")) | F.col("expression").isNull() | F.col("reason").isNull(), F.col("source")),
        (fact.filter("span IS NOT NULL"), "span", bad_path(s["path"]) | small | late, F.coalesce("id", "source")),
    ]
    found = [of.filter(F.coalesce(wrong, F.lit(True))).select(F.lit(name).alias("problem"), what.alias("what")) for of, name, wrong, what in rules]
    ids = fact.filter("record = 'node'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found.append(ids.filter("n > 1").select(F.lit("duplicate id").alias("problem"), F.col("id").alias("what")))
    ends = fact.filter("record = 'edge'").select(F.explode(F.array("source", "target")).alias("id")).unionByName(fact.filter("record = 'unresolved'").select(F.col("source").alias("id")))
    full = head.filter(F.coalesce("mode", F.lit("full")) == "full").select(F.lit(True).alias("full")).limit(1)
    found.append(ends.distinct().join(ids, "id", "left_anti").crossJoin(F.broadcast(full)).select(F.lit("unknown end").alias("problem"), F.col("id").alias("what")))
    kind = F.when(F.col("record") == "node", 0).when(F.col("record") == "edge", 1).otherwise(2)
    text = lambda *cs: [F.coalesce(c, F.lit("")) for c in cs]
    order = F.struct(kind, *(F.when(F.col("record") == "node", a).otherwise(b) for a, b in zip(text("id", "kind", "path", "qualified_name"), [
        *text("source"), F.when(F.col("record") == "edge", F.col("target")).otherwise(F.col("relation")),
        F.when(F.col("record") == "edge", F.col("relation")).otherwise(F.col("expression")), F.when(F.col("record") == "edge", F.lit("")).otherwise(F.col("reason"))], strict=True)), span_key(s))
    # neighbours within a block; blocks meet at their ends, of which there are few
    placed = fact.select("at", order.alias("key"))
    block = W.partitionBy(F.col("at")["file"], F.col("at")["block"]).orderBy("at")
    inside = placed.withColumn("before", F.lag("key").over(block)).filter(F.col("before") > F.col("key")).select(F.lit("order").alias("problem"), F.col("at")["file"].alias("what"))
    edges = placed.groupBy(F.col("at")["file"].alias("file"), F.col("at")["block"].alias("block")).agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(W.partitionBy("file").orderBy("block"))).filter(F.col("before") > F.col("first")).select(F.lit("order").alias("problem"), F.col("file").alias("what"))
    out = inside.unionByName(across)
    for more in found:
        out = out.unionByName(more)
    return out


#: Node kinds that no file owns.
SHARED_KINDS = "repository directory module namespace".split()


def node_owners(nodes: DataFrame) -> DataFrame:
    """nodes (key, kind, path, span_path) with owner: the span's path, else a path with an extension of a kind that files own, else null."""
    extension = F.regexp_extract("path", r"[^/]\.([^./]*)$", 0) != ""
    own = F.when(~F.col("kind").isin(SHARED_KINDS) & extension, F.col("path"))
    return nodes.withColumn("owner", F.coalesce("span_path", own))


def edge_owners(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """edges (src, dst, span_path, ...) with owner: the span's path, else the source's owner, else the target's. owners: (key, owner).

    Only edges without a span are joined.
    """
    known = owners.filter("owner IS NOT NULL").select("key", F.col("owner").alias("o")).dropDuplicates(["key"])
    loose = edges.filter("span_path IS NULL")
    loose = loose.join(known.select(F.col("key").alias("src"), F.col("o").alias("o1")), "src", "left").join(known.select(F.col("key").alias("dst"), F.col("o").alias("o2")), "dst", "left")
    loose = loose.withColumn("owner", F.coalesce("o1", "o2")).drop("o1", "o2")
    return edges.filter("span_path IS NOT NULL").withColumn("owner", F.col("span_path")).unionByName(loose)


def replaced(base: DataFrame, replacement: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts with owner: those of the base that unchanged files own, those of the replacement that changed files or none own. changed: (owner)."""
    kept = base.filter("owner IS NOT NULL").join(changed, "owner", "left_anti")
    return kept.unionByName(replacement.filter("owner IS NULL").unionByName(replacement.join(changed, "owner", "left_semi")))


def call_sites(calls: DataFrame) -> DataFrame:
    """(site, category, targets): calls (site, record, relation, target): definite_only, possible_only, definite_plus_possible, unresolved_only."""
    definite = F.coalesce(F.bool_or((F.col("record") == "edge") & (F.col("relation") == "calls")), F.lit(False))
    possible = F.count_distinct(F.when((F.col("record") == "edge") & (F.col("relation") != "calls"), F.col("target")))
    sites = calls.groupBy("site").agg(definite.alias("definite"), possible.alias("targets"))
    category = F.when(F.col("definite") & (F.col("targets") > 0), "definite_plus_possible").when(F.col("definite"), "definite_only").when(F.col("targets") > 0, "possible_only").otherwise("unresolved_only")
    return sites.select("site", category.alias("category"), "targets")


def depth(edges: DataFrame) -> DataFrame:
    """(relation, occurrences, pairs, loops): edges as they occur and as distinct pairs."""
    by_pair = edges.groupBy("relation", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return by_pair.groupBy("relation").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


#: Relations that say how code is laid out, and those that dispatch.
STRUCTURAL = "contains defines imports".split()
DISPATCH = "implements extends overrides uses-trait".split()


def report(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: totals, shares (to 6 places, null of nothing) and what the facts can tell."""
    count = lambda *rs: F.sum(F.when(F.col("relation").isin(*rs), F.col("n")).otherwise(0))
    e = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges"), count("calls").alias("definite"), count("possible-calls").alias("possible"), count("reads", "writes").alias("dataflow"),
        count(*DISPATCH).alias("dispatch"), count("depends-on").alias("dependencies"), count(*STRUCTURAL).alias("structural_edges"))
    ends = edges.filter(~F.col("relation").isin(STRUCTURAL)).select(F.explode(F.array("src", "dst")).alias("key")).distinct().agg(F.count(F.lit(1)).alias("semantic_endpoints"))
    rows = e.crossJoin(ends).crossJoin(nodes.agg(F.count(F.lit(1)).alias("total_nodes"))).crossJoin(unresolved.agg(F.count_if(F.col("relation") == "calls").alias("unresolved_calls")))
    ratio = lambda a, b: F.when(b != 0, F.round(a / b, 6))
    calls, c = F.col("definite") + F.col("possible") + F.col("unresolved_calls"), F.col
    return rows.select(
        "total_nodes", "total_edges", "structural_edges", (c("total_edges") - c("structural_edges")).alias("semantic_edges"), "semantic_endpoints", calls.alias("calls"),
        ratio(c("definite"), calls).alias("definite_fraction"), ratio(c("definite") + c("possible"), calls).alias("resolved_fraction"), ratio(c("total_edges"), c("total_nodes")).alias("edge_density"),
        ratio(c("total_edges") - c("structural_edges"), c("total_nodes")).alias("semantic_edge_density"), ratio(c("semantic_endpoints"), c("total_nodes")).alias("semantic_endpoint_fraction"),
        (c("dataflow") > 0).alias("has_dataflow"), (c("dispatch") > 0).alias("has_dispatch"), (c("dependencies") > 0).alias("has_dependencies"),
    )


def reconciled(observations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """observations (source, target, relation, count) with category: what the static facts (nodes: key, edges) say of each."""
    keys = nodes.select("key", F.lit(True).alias("known")).dropDuplicates(["key"])
    known = lambda c: keys.select(F.col("key").alias(c), F.col("known").alias(f"{c}_known"))
    pairs = edges.select("src", "dst", "relation").distinct().groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.collect_set("relation").alias("relations"))
    rows = observations.join(known("source"), "source", "left").join(known("target"), "target", "left").join(pairs, ["source", "target"], "left")
    has = lambda r: F.coalesce(F.array_contains("relations", r), F.lit(False))
    call = F.col("relation") == "calls"
    rule = F.when(F.col("source_known").isNull() | (F.col("target").isNotNull() & F.col("target_known").isNull()), "unknown-static-id").when(F.col("target").isNull(), "external-runtime-target")
    rule = rule.when(call & has("calls"), "confirmed-definite").when(call & has("possible-calls"), "confirmed-possible").when(has(F.col("relation")), "confirmed-definite").otherwise("unmodeled-static-target")
    return rows.select("source", "target", "relation", "count", rule.alias("category"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files (path, hash): added, removed, changed."""
    both = before.select("path", F.col("hash").alias("h0")).join(after.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def compared(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(*key, side): shared, left only, right only, of the distinct keys."""
    a, b = left.select(*key).distinct().withColumn("l", F.lit(1)), right.select(*key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right only").when(F.col("r").isNull(), "left only").otherwise("shared")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))


def enclosing(points: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """points (path, line, ...) with owner: the first span (path, start_line, end_line, key) around the line, else the last before it, else the file (path, key).

    One sort of points and spans by path and line: of the spans so far the last one, and, of those that reach the
    line, the one that starts first, which is known if the greatest end so far reaches it; then a join settles it.
    """
    at = W.partitionBy("path").orderBy("line", "is_point", "key").rowsBetween(W.unboundedPreceding, 0)
    columns = [c for c in points.columns if c not in ("path", "line")]
    p = points.select("path", "line", F.lit(1).alias("is_point"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("end"), F.struct(*columns).alias("rest"))
    s = spans.select("path", F.col("start_line").alias("line"), F.lit(0).alias("is_point"), "key", F.col("end_line").cast("int").alias("end"), F.lit(None).cast(p.schema["rest"].dataType).alias("rest"))
    so_far = p.unionByName(s).withColumns({"last": F.last("key", ignorenulls=True).over(at), "reach": F.max("end").over(at)}).filter("is_point = 1")
    around = so_far.filter("reach >= line").select("path", "line").distinct().join(spans.select("path", "start_line", "end_line", "key"), "path").filter("start_line <= line AND end_line >= line")
    around = around.groupBy("path", "line").agg(F.min_by("key", F.struct("start_line", "key")).alias("inside"))
    rows = so_far.join(around, ["path", "line"], "left").join(files.select("path", F.col("key").alias("file")), "path", "left")
    return rows.select("path", "line", "rest.*", F.coalesce("inside", "last", "file").alias("owner"))


def unique_match(asked: DataFrame, named: DataFrame) -> DataFrame:
    """asked (name, ...) with the key of the one node (name, key) of that name; null where there is none or several."""
    one = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1").select("name", "key")
    return asked.join(one, "name", "left")


def contracts(producers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(producer, endpoint): routes of one shape whose methods agree: equal, or any on either side (empty, *).

    A producer's or an endpoint's methods for a shape are one row, so that only pairs of which both have several shapes
    can come twice and need to be made distinct. The producers of a shape with many pairs are dealt over tasks of about
    PAIRS pairs each, to which its endpoints are copied.
    """
    def of(rows: DataFrame, who: str, methods: str) -> DataFrame:
        grouped = rows.groupBy(who, "shape").agg(F.collect_set("method").alias(methods))
        return grouped.withColumn(f"{who}_many", F.count(F.lit(1)).over(W.partitionBy(who)) > 1)

    p, e = of(producers, "producer", "asked"), of(endpoints, "endpoint", "served")
    sizes = p.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).join(e.groupBy("shape").agg(F.count(F.lit(1)).alias("m")), "shape")
    pairs = F.col("n").cast("double") * F.col("m")
    shares = sizes.select("shape", F.least("n", F.ceil(pairs / PAIRS)).cast("int").alias("shares"), pairs.alias("pairs"))
    total = shares.agg(F.sum("pairs")).first()[0] or 0
    tasks = int(min(4096, max(total // PAIRS + 1, int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    shares = shares.drop("pairs")
    p = p.join(shares, "shape").withColumn("share", F.pmod(F.xxhash64("producer"), F.col("shares")).cast("int")).drop("shares").repartition(tasks, "shape", "share")
    e = e.join(shares, "shape").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares").repartition(tasks, "shape", "share")
    met = p.join(e, ["shape", "share"]).filter(F.array_contains("asked", "") | F.array_contains("served", "*") | F.arrays_overlap("asked", "served"))
    again = F.col("producer_many") & F.col("endpoint_many")
    return met.filter(~again).select("producer", "endpoint").unionByName(met.filter(again).select("producer", "endpoint").distinct())


def merged(descriptors: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the first non-empty text, the greatest score, reasons as a set in the order first seen, ties by text. descriptors: (key, order, text, score, reasons)."""
    text = F.min_by("text", F.when(F.col("text") != "", F.struct(order, "text")))
    basic = descriptors.groupBy(key).agg(F.coalesce(text, F.lit("")).alias("text"), F.max("score").alias("score"))
    seen = descriptors.select(key, order, F.posexplode("reasons").alias("i", "reason")).groupBy(key, "reason").agg(F.min(F.struct(order, "i")).alias("at"))
    listed = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return basic.join(listed, key, "left")


def lane_coverage(rows: DataFrame) -> DataFrame:
    """(lane, available, returned, previewed, deferred, suppressed) of results (lane, returned, previewed, duplicate)."""
    c = F.col
    out = rows.groupBy("lane").agg(F.count_if(~c("duplicate")).alias("available"), F.count_if(c("returned") & ~c("duplicate")).alias("returned"), F.count_if(c("previewed") & c("returned") & ~c("duplicate")).alias("previewed"), F.count_if("duplicate").alias("suppressed"))
    return out.withColumn("deferred", c("available") - c("returned"))


def reusable(before: DataFrame, now: DataFrame) -> DataFrame:
    """now (path, hash, size, preparation) with reused: whether an earlier index has that file as it is."""
    key = ["path", "hash", "size", "preparation"]
    return now.join(before.select(*key).distinct().withColumn("reused", F.lit(True)), key, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def garbage(versions: DataFrame, keep: int) -> DataFrame:
    """Versions (name, current, pinned, at) to delete: neither the current one, nor pinned, nor among the last `keep`."""
    place = F.row_number().over(W.orderBy(F.desc("at"), "name"))
    return versions.withColumn("place", place).filter(~F.col("current") & ~F.col("pinned") & (F.col("place") > keep)).select("name")


def source_spans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, start_line, end_line, kind, name): declarations (key, kind, name, qualified_name, path, start_line, end_line) that bound chunks.

    Functions, methods, tests and types that no callable defines, in files of the repository; edges: (src, dst, relation).
    """
    kind = F.lower(F.trim("kind"))
    callers = nodes.filter(kind.isin("function", "method", "test")).select(F.col("key").alias("src"))
    inner = edges.filter("relation = 'defines'").join(callers, "src", "left_semi").select(F.col("dst").alias("key"))
    rows = nodes.filter(kind.isin("function", "method", "test", "type") & (F.col("start_line") > 0) & (F.trim("path") != "") & ~F.trim("path").startswith("@")).join(inner, "key", "left_anti")
    name = F.when(F.trim("name") != "", F.trim("name")).otherwise(F.trim("qualified_name"))
    return rows.select(F.trim("path").alias("path"), "start_line", F.greatest("start_line", "end_line").alias("end_line"), kind.alias("kind"), name.alias("name"))
