"""Queries over facts: streams, owners, call sites, reports, runtime evidence, changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnwork.operators import facts, graph, metrics
from cairnwork.plans import views as V
from cairnwork.plans.base import query
from cairnwork.plans.storage import shared_folder

key = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))


def stream_of_parts(spark, d, valid: bool = True):
    """Paths of two folders of JSONL files, in ranges that are each sorted by one task: parts as nodes, their calls as edges, then the brands of some again under the same ids."""
    folder = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    ident = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256))
    parts = V.table(spark, d, "part")
    node = lambda name: F.to_json(F.struct(F.lit("node").alias("record"), ident(F.col("p_partkey")).alias("id"), F.lit("function").alias("kind"), F.col(name).alias("name"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".go")).alias("path"), F.concat_ws(".", "p_brand", name).alias("qualified_name")))
    head = spark.range(1).select(F.to_json(F.struct(F.lit("facts").alias("record"), F.lit(1).alias("schema_version"), F.lit("1").alias("adapter_version"), F.lit("go").alias("language"), F.lit("r").alias("repository"))).alias("value"))
    calls = V.call_graph(spark, d).filter("relation = 'calls'")
    plain = lambda c: F.substring(c, 3, 20)
    edges = calls.select(F.to_json(F.struct(F.lit("edge").alias("record"), ident(plain(F.col("src"))).alias("source"), ident(plain(F.col("dst"))).alias("target"), "relation")).alias("value"), ident(plain(F.col("src"))).alias("o"))
    nodes = parts.select(node("p_name").alias("value"), ident(F.col("p_partkey")).alias("o"))
    first = head.withColumn("k", F.lit(0)).withColumn("o", F.lit("")).unionByName(nodes.withColumn("k", F.lit(1))).unionByName(edges.withColumn("k", F.lit(2)))
    first.repartitionByRange("k", "o").sortWithinPartitions("k", "o").select("value").write.text(f"{folder}/a")
    if valid:
        return [f"{folder}/a"]
    parts.filter("p_size > 30").select(node("p_type").alias("value")).write.text(f"{folder}/b")
    return [f"{folder}/a", f"{folder}/b"]


@query("sc_08_fact_stream", "SELECT 'sha256:' || sha256(CAST(p_partkey AS VARCHAR)) AS id, CASE WHEN p_size > 30 THEN p_type ELSE p_name END AS name, p_brand || '.' || CASE WHEN p_size > 30 THEN p_type ELSE p_name END AS qualified_name FROM part")
def sc_08(spark, d):
    return facts.read_facts(spark, stream_of_parts(spark, d, valid=False))[0].select("id", "name", "qualified_name")


@query("sc_09_fact_edges", "WITH " + V.CALLS_SQL + " SELECT 'sha256:' || sha256(substr(src, 3)) AS source, 'sha256:' || sha256(substr(dst, 3)) AS target, relation FROM call_graph WHERE relation = 'calls'")
def sc_09(spark, d):
    return facts.read_facts(spark, stream_of_parts(spark, d))[1].select("source", "target", "relation")


@query("sc_10_fact_problems", "SELECT 'duplicate id' AS problem, 'sha256:' || sha256(CAST(p_partkey AS VARCHAR)) AS what FROM part WHERE p_size > 30")
def sc_10(spark, d):
    """The sound stream has no problem; with the second file some ids are there twice (its order is a file's own)."""
    sound = facts.problems(facts.parsed(spark, stream_of_parts(spark, d)))
    both = facts.problems(facts.parsed(spark, stream_of_parts(spark, d, valid=False)))
    return sound.unionByName(both.filter("problem <> 'order'"))


OWNER_SQL = """
n AS (SELECT 'p:' || p_partkey AS key, 'function' AS kind, CASE WHEN p_size % 3 = 0 THEN 'src/' || p_brand ELSE 'src/' || p_brand || '.go' END AS path, CASE WHEN p_size > 45 THEN 'span/' || p_size || '.go' END AS span_path FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'module', 'mod/' || s_suppkey || '.go', NULL FROM supplier),
own AS (SELECT *, coalesce(span_path, CASE WHEN kind <> 'module' AND path LIKE '%.go' THEN path END) AS owner FROM n),
e AS (SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, CASE WHEN l_linenumber = 1 THEN 'at/' || l_linestatus || '.go' END AS span_path FROM lineitem)"""


def owned(spark, d):
    parts, lines = V.table(spark, d, "part"), V.table(spark, d, "lineitem")
    folder = F.concat(F.lit("src/"), F.col("p_brand"))
    path = F.when(F.col("p_size") % 3 == 0, folder).otherwise(F.concat(folder, F.lit(".go")))
    n = parts.select(key("p", "p_partkey").alias("key"), F.lit("function").alias("kind"), path.alias("path"), F.when(F.col("p_size") > 45, F.concat(F.lit("span/"), F.col("p_size").cast("string"), F.lit(".go"))).alias("span_path"))
    n = n.unionByName(V.table(spark, d, "supplier").select(key("s", "s_suppkey").alias("key"), F.lit("module").alias("kind"), F.concat(F.lit("mod/"), F.col("s_suppkey").cast("string"), F.lit(".go")).alias("path"), F.lit(None).cast("string").alias("span_path")))
    e = lines.select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("at/"), F.col("l_linestatus"), F.lit(".go"))).alias("span_path"))
    return facts.node_owners(n), e


@query("gr_26_node_owners", "WITH" + OWNER_SQL + " SELECT key, owner FROM own")
def gr_26_nodes(spark, d):
    return owned(spark, d)[0].select("key", "owner")


@query("jn_03_edge_owners", "WITH" + OWNER_SQL + " SELECT owner, count(*) AS n FROM (SELECT coalesce(e.span_path, a.owner, b.owner) AS owner FROM e LEFT JOIN own a ON src = a.key LEFT JOIN own b ON dst = b.key) GROUP BY owner")
def jn_03(spark, d):
    nodes, edges = owned(spark, d)
    return facts.edge_owners(edges, nodes).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("gr_26_replaced", "WITH" + OWNER_SQL + ", c AS (SELECT DISTINCT 'src/' || p_brand || '.go' AS owner FROM part WHERE p_size > 40) SELECT key, owner, 'old' AS stamp FROM own WHERE owner IS NOT NULL AND owner NOT IN (SELECT owner FROM c) UNION ALL SELECT key, owner, 'new' FROM own WHERE owner IS NULL OR owner IN (SELECT owner FROM c)")
def gr_26_replaced(spark, d):
    nodes = owned(spark, d)[0].select("key", "owner")
    changed = V.table(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".go")).alias("owner")).distinct()
    return facts.replaced(nodes.withColumn("stamp", F.lit("old")), nodes.withColumn("stamp", F.lit("new")), changed)


@query("jn_02_endpoints", f"WITH {V.EDGES_SQL}, {V.NODES_SQL} SELECT a.kind AS source_kind, relation, b.kind AS target_kind, count(*) AS n FROM edges JOIN nodes a ON src = a.key JOIN nodes b ON dst = b.key GROUP BY ALL")
def jn_02(spark, d):
    kinds = V.nodes(spark, d).select("key", "kind")
    rows = V.edges(spark, d).join(kinds.select(F.col("key").alias("src"), F.col("kind").alias("source_kind")), "src").join(kinds.select(F.col("key").alias("dst"), F.col("kind").alias("target_kind")), "dst")
    return rows.groupBy("source_kind", "relation", "target_kind").agg(F.count(F.lit(1)).alias("n"))


SITES_SQL = "sites AS (SELECT 'o:' || l_orderkey AS site, 'edge' AS record, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'possible-calls' END AS relation, 'p:' || l_partkey AS target FROM lineitem UNION ALL SELECT 'o:' || o_orderkey, 'unresolved', 'calls', NULL FROM orders)"


def sites(spark, d):
    one = V.table(spark, d, "lineitem").select(key("o", "l_orderkey").alias("site"), F.lit("edge").alias("record"), F.when(F.col("l_returnflag") == "R", "calls").otherwise("possible-calls").alias("relation"), key("p", "l_partkey").alias("target"))
    return one.unionByName(V.table(spark, d, "orders").select(key("o", "o_orderkey").alias("site"), F.lit("unresolved").alias("record"), F.lit("calls").alias("relation"), F.lit(None).cast("string").alias("target")))


@query("ag_09_call_sites", "WITH " + SITES_SQL + """, g AS (SELECT site, bool_or(record = 'edge' AND relation = 'calls') AS d, count(DISTINCT CASE WHEN record = 'edge' AND relation <> 'calls' THEN target END) AS t FROM sites GROUP BY site)
SELECT CASE WHEN d AND t > 0 THEN 'definite_plus_possible' WHEN d THEN 'definite_only' WHEN t > 0 THEN 'possible_only' ELSE 'unresolved_only' END AS category, count(*) AS n, max(t) AS most FROM g GROUP BY 1""")
def ag_09(spark, d):
    return facts.call_sites(sites(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("targets").alias("most"))


@query("ag_10_depth", f"WITH {V.EDGES_SQL}, g AS (SELECT relation, src, dst, count(*) AS n FROM edges GROUP BY ALL) SELECT relation, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS pairs, count(*) FILTER (src = dst) AS loops FROM g GROUP BY relation")
def ag_10(spark, d):
    return facts.depth(V.edges(spark, d))


@query("ag_11_report", f"WITH {V.EDGES_SQL}, {V.NODES_SQL}, {V.UNRESOLVED_SQL}, " + """
e AS (SELECT count(*) AS total_edges, count(*) FILTER (relation = 'calls') AS d, count(*) FILTER (relation = 'possible-calls') AS p, count(*) FILTER (relation = 'contains') AS st FROM edges),
s AS (SELECT count(DISTINCT k) AS ends FROM (SELECT src AS k FROM edges WHERE relation <> 'contains' UNION ALL SELECT dst FROM edges WHERE relation <> 'contains')), n AS (SELECT count(*) AS total_nodes FROM nodes), u AS (SELECT count(*) AS u FROM unresolved WHERE relation = 'calls')
SELECT total_nodes, total_edges, st AS structural_edges, total_edges - st AS semantic_edges, ends AS semantic_endpoints, d + p + u AS calls, round(d / (d + p + u), 6) AS definite_fraction, round((d + p) / (d + p + u), 6) AS resolved_fraction, round(total_edges / total_nodes, 6) AS edge_density,
 round((total_edges - st) / total_nodes, 6) AS semantic_edge_density, round(ends / total_nodes, 6) AS semantic_endpoint_fraction, false AS has_dataflow, false AS has_dispatch, false AS has_dependencies FROM e, s, n, u""")
def ag_11(spark, d):
    return facts.report(V.nodes(spark, d), V.edges(spark, d), V.unresolved(spark, d))


@query("jn_14_reconciled", f"WITH {V.NODES_SQL}, " + """
e AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'possible-calls' END AS relation FROM lineitem UNION SELECT DISTINCT 'o:' || o_orderkey, 'c:' || o_custkey, 'reads' FROM orders),
o AS (SELECT CASE WHEN l_linenumber > 3 THEN 'reads' ELSE 'calls' END AS relation, CASE WHEN l_quantity > 48 THEN 'z:' ELSE 'o:' END || l_orderkey AS source, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'p:' || l_partkey ELSE 'p:' || (l_partkey + 1) END AS target, CAST(l_quantity AS BIGINT) AS n FROM lineitem
  UNION ALL SELECT 'reads', 'o:' || o_orderkey, 'c:' || o_custkey, 1 FROM orders),
h AS (SELECT o.*, CASE WHEN source NOT IN (SELECT key FROM nodes) OR (target IS NOT NULL AND target NOT IN (SELECT key FROM nodes)) THEN 'unknown-static-id' WHEN target IS NULL THEN 'external-runtime-target'
  WHEN relation = 'calls' AND (source, target, 'calls') IN (SELECT (src, dst, relation) FROM e) THEN 'confirmed-definite' WHEN relation = 'calls' AND (source, target, 'possible-calls') IN (SELECT (src, dst, relation) FROM e) THEN 'confirmed-possible'
  WHEN (source, target, relation) IN (SELECT (src, dst, relation) FROM e) THEN 'confirmed-definite' ELSE 'unmodeled-static-target' END AS category FROM o)
SELECT category, relation, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL""")
def jn_14(spark, d):
    lines, orders = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    edges = lines.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "calls").otherwise("possible-calls").alias("relation"))
    edges = edges.unionByName(orders.select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), F.lit("reads").alias("relation")))
    source = F.concat(F.when(F.col("l_quantity") > 48, "z:").otherwise("o:"), F.col("l_orderkey").cast("string"))
    target = F.when(F.col("l_linenumber") % 3 == 1, key("p", "l_partkey")).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("p:"), (F.col("l_partkey") + 1).cast("string")))
    seen = lines.select(F.when(F.col("l_linenumber") > 3, "reads").otherwise("calls").alias("relation"), source.alias("source"), target.alias("target"), F.col("l_quantity").cast("long").alias("count"))
    seen = seen.unionByName(orders.select(F.lit("reads").alias("relation"), key("o", "o_orderkey").alias("source"), key("c", "o_custkey").alias("target"), F.lit(1).cast("long").alias("count")))
    return facts.reconciled(seen, V.nodes(spark, d), edges).groupBy("category", "relation").agg(F.sum("count").alias("n"))


FILES_SQL = "f0 AS (SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS hash FROM documents WHERE lang <> 'fr'), f1 AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN lang = 'de' THEN 'new ' ELSE '' END || coalesce(text, '')) AS hash FROM documents WHERE lang <> 'es')"


def two_versions(spark, d):
    docs, path = V.table(spark, d, "documents"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    text = F.coalesce("text", F.lit(""))
    return docs.filter("lang <> 'fr'").select(path, F.sha2(text, 256).alias("hash")), docs.filter("lang <> 'es'").select(path, F.sha2(F.concat(F.when(F.col("lang") == "de", "new ").otherwise(""), text), 256).alias("hash"))


@query("so_05_file_changes", "WITH " + FILES_SQL + " SELECT coalesce(f0.path, f1.path) AS path, CASE WHEN f0.path IS NULL THEN 'added' WHEN f1.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM f0 FULL JOIN f1 ON f0.path = f1.path WHERE f0.hash IS DISTINCT FROM f1.hash")
def so_05(spark, d):
    return facts.file_changes(*two_versions(spark, d))


@query("st_02_reused_files", "WITH " + FILES_SQL + " SELECT f1.path, EXISTS (SELECT 1 FROM f0 WHERE f0.path = f1.path AND f0.hash = f1.hash) AS reused FROM f1")
def st_02(spark, d):
    before, now = (x.withColumns({"size": F.lit(1), "preparation": F.lit("p")}) for x in two_versions(spark, d))
    return facts.reusable(before, now).select("path", "reused")


@query("st_03_incremental_merge", "WITH " + FILES_SQL + ", c AS (SELECT coalesce(f0.path, f1.path) AS path FROM f0 FULL JOIN f1 ON f0.path = f1.path WHERE f0.hash IS DISTINCT FROM f1.hash) SELECT path, hash FROM f0 WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, hash FROM f1 WHERE path IN (SELECT path FROM c)")
def st_03(spark, d):
    before, now = two_versions(spark, d)
    changed = facts.file_changes(before, now).select(F.col("path").alias("owner"))
    own = lambda x: x.withColumn("owner", F.col("path"))
    return facts.replaced(own(before), own(now), changed).select("path", "hash")


@query("so_04_compared", "WITH " + FILES_SQL + " SELECT coalesce(f0.path, f1.path) AS path, CASE WHEN f0.path IS NULL THEN 'right only' WHEN f1.path IS NULL THEN 'left only' ELSE 'shared' END AS side FROM f0 FULL JOIN f1 ON f0.path = f1.path")
def so_04(spark, d):
    return facts.compared(*two_versions(spark, d), ["path"])


@query("st_08_freshness", "SELECT source, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(sum(crc32) AS BIGINT) AS fingerprint FROM (SELECT source, text, CAST('0x' || substr(sha256(doc_id || ':' || coalesce(text, '')), 1, 8) AS BIGINT) AS crc32 FROM documents) GROUP BY source")
def st_08(spark, d):
    """A fingerprint that no order changes: a sum of hashes, which aggregates before it is shuffled."""
    word = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return V.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("bytes"), F.sum(word).alias("fingerprint"))


@query("st_07_garbage", "SELECT name FROM (SELECT n_name AS name, n_nationkey = 3 AS cur, n_nationkey % 7 = 0 AS pin, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS i FROM nation) WHERE NOT cur AND NOT pin AND i > 5")
def st_07(spark, d):
    rows = V.table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") == 3).alias("current"), (F.col("n_nationkey") % 7 == 0).alias("pinned"), F.col("n_regionkey").alias("at"))
    return facts.garbage(rows, 5)


@query("jn_10_enclosing", """
WITH s AS (SELECT 'u' || user_id AS path, CAST(event_id % 97 AS INTEGER) AS s, CAST(event_id % 97 + event_id % 11 AS INTEGER) AS e, 's' || event_id AS key FROM events WHERE event_type <> 'error'),
p AS (SELECT 'u' || user_id AS path, CAST(event_id % 89 AS INTEGER) AS line, event_id FROM events WHERE event_type = 'error')
SELECT event_id, coalesce((SELECT key FROM s WHERE s.path = p.path AND s.s <= line AND s.e >= line ORDER BY s.s, key LIMIT 1), (SELECT key FROM s WHERE s.path = p.path AND s.s <= line ORDER BY s.s DESC, key DESC LIMIT 1), 'file ' || path) AS owner FROM p""")
def jn_10(spark, d):
    e, path = V.table(spark, d, "events"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")
    start = (F.col("event_id") % 97).cast("int")
    spans = e.filter("event_type <> 'error'").select(path, start.alias("start_line"), (start + F.col("event_id") % 11).cast("int").alias("end_line"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("key"))
    points = e.filter("event_type = 'error'").select(path, (F.col("event_id") % 89).cast("int").alias("line"), "event_id")
    files = e.select(path).distinct().withColumn("key", F.concat(F.lit("file "), F.col("path")))
    return facts.enclosing(points, spans, files).select("event_id", "owner")


@query("jn_11_unique_names", "WITH n AS (SELECT p_name AS name, 'p:' || p_partkey AS key FROM part UNION ALL SELECT c_name, 'c:' || c_custkey FROM customer), a AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT 'none') SELECT name, (SELECT min(key) FROM n WHERE n.name = a.name HAVING count(*) = 1) AS key FROM a")
def jn_11(spark, d):
    parts, customers = V.table(spark, d, "part"), V.table(spark, d, "customer")
    named = parts.select(F.col("p_name").alias("name"), key("p", "p_partkey").alias("key")).unionByName(customers.select(F.col("c_name").alias("name"), key("c", "c_custkey").alias("key")))
    asked = named.select("name").unionByName(spark.createDataFrame([("none",)], "name string")).distinct()
    return facts.unique_match(asked, named)


@query("jn_12_routes", """
WITH p AS (SELECT p_partkey AS producer, '/api/' || p_type || '/{}' AS shape, ['', 'GET', 'POST'][p_size % 3 + 1] AS m FROM part), e AS (SELECT s_suppkey AS endpoint, '/api/' || (SELECT min(p_type) FROM part) || '/{}' AS shape, ['*', 'GET', 'PUT'][s_suppkey % 3 + 1] AS method FROM supplier)
SELECT DISTINCT producer, endpoint FROM p JOIN e USING (shape) WHERE m = '' OR method = '*' OR m = method""")
def jn_12(spark, d):
    parts = V.table(spark, d, "part")
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % 3 + 1).cast("int"))
    producers = parts.select(F.col("p_partkey").alias("producer"), F.concat(F.lit("/api/"), "p_type", F.lit("/{}")).alias("shape"), pick(["", "GET", "POST"], "p_size").alias("method"))
    least = parts.agg(F.concat(F.lit("/api/"), F.min("p_type"), F.lit("/{}")).alias("shape"))
    return facts.contracts(producers, V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("endpoint"), pick(["*", "GET", "PUT"], "s_suppkey").alias("method")).crossJoin(F.broadcast(least)))


@query("ag_18_merged_evidence", """
WITH r AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS i, CASE WHEN l_quantity > 20 THEN l_returnflag || l_linestatus ELSE '' END AS text, l_extendedprice AS score, [l_returnflag, l_linestatus] AS reasons FROM lineitem),
s AS (SELECT key, reason, min((i, j)) AS pos FROM (SELECT key, i, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS j FROM r) GROUP BY ALL)
SELECT key, (SELECT coalesce(arg_min(text, (i, text)) FILTER (text <> ''), '') FROM r WHERE r.key = k.key) AS text, (SELECT max(score) FROM r WHERE r.key = k.key) AS score, (SELECT string_agg(reason, ',' ORDER BY pos, reason) FROM s WHERE s.key = k.key) AS reasons FROM (SELECT DISTINCT key FROM r) k""")
def ag_18(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.when(F.col("l_quantity") > 20, F.concat("l_returnflag", "l_linestatus")).otherwise("").alias("text"), F.col("l_extendedprice").alias("score"), F.array("l_returnflag", "l_linestatus").alias("reasons"))
    return facts.merged(rows.withColumnRenamed("i", "seen"), "key", "seen").withColumn("reasons", F.array_join("reasons", ","))


@query("ag_19_lane_coverage", "SELECT l_shipmode AS lane FROM (SELECT 1 AS l_shipmode) WHERE false".replace("SELECT l_shipmode AS lane FROM (SELECT 1 AS l_shipmode) WHERE false", "WITH r AS (SELECT l_returnflag AS lane, l_quantity > 10 AS ret, l_quantity > 40 AS pre, l_linenumber = 7 AS dup FROM lineitem) SELECT lane, count(*) FILTER (NOT dup) AS available, count(*) FILTER (ret AND NOT dup) AS returned, count(*) FILTER (ret AND pre AND NOT dup) AS previewed, count(*) FILTER (dup) AS suppressed, count(*) FILTER (NOT dup) - count(*) FILTER (ret AND NOT dup) AS deferred FROM r GROUP BY lane"))
def ag_19(spark, d):
    c = F.col
    return facts.lane_coverage(V.table(spark, d, "lineitem").select(c("l_returnflag").alias("lane"), (c("l_quantity") > 10).alias("returned"), (c("l_quantity") > 40).alias("previewed"), (c("l_linenumber") == 7).alias("duplicate")))


@query("ag_12_case_scores", """
WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), x AS (SELECT o_custkey AS case_id, o_orderkey AS doc_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'required' WHEN '2' THEN 'supporting' WHEN '5' THEN 'forbidden' END AS role FROM orders),
m AS (SELECT r.*, role FROM (SELECT * FROM r WHERE rank <= 6) r LEFT JOIN x USING (case_id, doc_id)), w AS (SELECT case_id, count(*) FILTER (role = 'required') AS wanted FROM x GROUP BY case_id),
g AS (SELECT case_id, count(*) AS results, count(*) FILTER (role = 'required') AS found, count(*) FILTER (role = 'required' AND rank <= 1) AS a1, count(*) FILTER (role = 'required' AND rank <= 3) AS a3, count(*) FILTER (role IS NULL OR role = 'forbidden') AS irr, count(*) FILTER (role = 'forbidden') AS forb, min(rank) FILTER (role IN ('required', 'supporting')) AS f FROM m GROUP BY case_id)
SELECT case_id, round(CASE WHEN wanted > 0 THEN found / wanted ELSE 0 END, 6) AS recall, round(CASE WHEN wanted > 0 THEN a1 / wanted ELSE 0 END, 6) AS recall_1, round(CASE WHEN wanted > 0 THEN a3 / wanted ELSE 0 END, 6) AS recall_3, round(coalesce(1 / f, 0), 6) AS mrr, round(irr / results, 6) AS irrelevant_rate, found = wanted AND forb = 0 AS passed FROM g JOIN w USING (case_id)""")
def ag_12(spark, d):
    from pyspark.sql import Window as W

    o = V.table(spark, d, "orders")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    results = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), rank.alias("rank")).filter("rank <= 6")
    first = F.substring("o_orderpriority", 1, 1)
    role = F.when(first == "1", "required").when(first == "2", "supporting").when(first == "5", "forbidden")
    return metrics.cases(results, o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_id"), role.alias("role")), [1, 3])


@query("ag_13_paired_modes", """
WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' WHEN o_orderstatus = 'O' THEN 'b' ELSE 'c' END AS mode, o_orderpriority AS measure, o_totalprice AS value FROM orders),
g AS (SELECT measure, round(avg(value) FILTER (mode = 'a'), 6) AS base, round(avg(value) FILTER (mode = 'b'), 6) AS other FROM r WHERE mode <> 'c' GROUP BY measure) SELECT measure, round(base, 3) AS base, round(other, 3) AS other, round(other - base, 3) AS delta FROM g""")
def ag_13(spark, d):
    mode = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "b").otherwise("c")
    rows = V.table(spark, d, "orders").select(mode.alias("mode"), F.col("o_orderpriority").alias("measure"), F.col("o_totalprice").alias("value"))
    return metrics.paired(rows, "a", "b").select("measure", *(F.round(c, 3).alias(c) for c in ("base", "other", "delta")))


@query("ag_17_sample_summaries", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, min(value) AS least, max(value) FILTER (i = ceil(n / 2)) AS median, max(value) AS most FROM r GROUP BY event_type")
def ag_17(spark, d):
    return metrics.summaries(V.table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query("ag_15_compared_counts", f"WITH {V.EDGES_SQL}, b AS (SELECT relation, count(*) AS n FROM edges GROUP BY 1), a AS (SELECT relation, count(*) AS n FROM (SELECT DISTINCT * FROM edges WHERE relation <> 'contains') GROUP BY 1) SELECT relation, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a USING (relation)")
def ag_15(spark, d):
    e = V.edges(spark, d)
    count = lambda x, n: x.groupBy("relation").agg(F.count(F.lit(1)).alias(n))
    both = count(e, "before").join(count(graph.distinct_edges(e.filter("relation <> 'contains'")), "after"), "relation", "full_outer").fillna(0)
    return both.withColumn("delta", F.col("after") - F.col("before"))


@query("tx_07_source_spans", """
WITH n AS (SELECT 'p:' || p_partkey AS key, ['function', 'type', 'Method ', 'variable'][p_partkey % 4 + 1] AS kind, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END AS name, 'q.' || p_name AS qualified_name, CASE WHEN p_size % 11 = 0 THEN '@x' ELSE p_brand END AS path, p_size % 50 AS s, p_size % 50 - 2 + p_partkey % 5 AS e FROM part),
d AS (SELECT 'p:' || p_partkey AS src, 'p:' || (p_partkey * 3 + 1) AS dst FROM part), i AS (SELECT dst FROM d JOIN n ON src = key WHERE lower(trim(kind)) IN ('function', 'method'))
SELECT path, s AS start_line, greatest(s, e) AS end_line, lower(trim(kind)) AS kind, CASE WHEN trim(name) <> '' THEN trim(name) ELSE qualified_name END AS name FROM n WHERE kind <> 'variable' AND s > 0 AND path NOT LIKE '@%' AND key NOT IN (SELECT dst FROM i)""")
def tx_07(spark, d):
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    size = F.col("p_size")
    nodes = p.select(key("p", "p_partkey").alias("key"), F.element_at(F.array(*map(F.lit, ("function", "type", "Method ", "variable"))), (k % 4 + 1).cast("int")).alias("kind"), F.when(size % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("q."), "p_name").alias("qualified_name"), F.when(size % 11 == 0, "@x").otherwise(F.col("p_brand")).alias("path"), (size % 50).alias("start_line"), (size % 50 - 2 + k % 5).alias("end_line"))
    edges = p.select(key("p", "p_partkey").alias("src"), F.concat(F.lit("p:"), (k * 3 + 1).cast("string")).alias("dst"), F.lit("defines").alias("relation"))
    return facts.source_spans(nodes, edges)


@query("sc_14_dependencies", """
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT 'a/' || k || '/package.json' AS path, 'npm' AS ecosystem, 'lib' || k AS target, 'dependency:npm:lib' || k AS identity, 'runtime' AS category, '^' || s || '.0' AS "constraint", 'dependencies' AS source FROM p
UNION ALL SELECT 'a/' || k || '/package.json', 'npm', 'dev-' || s, 'dependency:npm:dev-' || s, 'development', '*', 'devDependencies' FROM p
UNION ALL SELECT 'a/' || k || '/requirements-dev.txt', 'pypi', 'my-lib' || k, 'dependency:pypi:my-lib' || k, 'runtime', '>=' || s, 'requirements' FROM p UNION ALL SELECT 'a/' || k || '/requirements-dev.txt', 'pypi', 'plain', 'dependency:pypi:plain', 'runtime', '', 'requirements' FROM p
UNION ALL SELECT 'a/' || k || '/go.mod', 'go', 'example.com/m' || k, 'dependency:go:example.com/m' || k, 'runtime', 'v1.' || s || '.0', 'require' FROM p""")
def sc_14(spark, d):
    from cairnwork.sources import manifests

    p = V.table(spark, d, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    made = {
        "package.json": F.concat(F.lit('{"dependencies": {"lib'), k, F.lit('": "^'), s, F.lit('.0", "here": "file:../x"}, "devDependencies": {"dev-'), s, F.lit('": "*"}}')),
        "requirements-dev.txt": F.concat(F.lit("My_Lib"), k, F.lit("[x] >="), s, F.lit("  # why\n-e .\nplain\ngit+https://x/y\n")),
        "go.mod": F.concat(F.lit("module m\n\nrequire (\n\texample.com/m"), k, F.lit(" v1."), s, F.lit(".0\n)\n")),
    }
    rows = [p.select(F.concat(F.lit("a/"), k, F.lit(f"/{name}")).alias("path"), text.alias("text")) for name, text in made.items()]
    return manifests.dependencies(rows[0].unionByName(rows[1]).unionByName(rows[2]))
