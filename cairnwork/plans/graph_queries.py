"""Queries over property graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import graph
from cairnwork.plans import views as V
from cairnwork.plans.base import query

GRAPH = f"WITH RECURSIVE {V.EDGES_SQL}, {V.NODES_SQL}"
CALLS = f"WITH RECURSIVE {V.CALLS_SQL}"


@query("rk_17_name_search", GRAPH + r""", q AS (SELECT key, list_filter([CASE WHEN lower(name) = 'nation_1' THEN 0 WHEN starts_with(lower(name), 'nation_1') THEN 3 WHEN contains(lower(name), 'nation_1') THEN 6 END,
  CASE WHEN lower(qualified_name) = 'nation_1' THEN 1 WHEN starts_with(lower(qualified_name), 'nation_1') THEN 4 WHEN contains(lower(qualified_name), 'nation_1') THEN 7 END, CASE WHEN path = 'nation_1' THEN 2 WHEN starts_with(path, 'nation_1') THEN 5 WHEN contains(path, 'nation_1') THEN 8 END], lambda x: x IS NOT NULL) AS r FROM nodes)
SELECT key, CAST(list_min(r) AS BIGINT) AS rank, CAST(len(r) AS INTEGER) AS fields FROM q WHERE len(r) > 0""")
def rk_17(spark, d):
    return graph.name_ranks(V.nodes(spark, d), " NATION_1 ").withColumn("fields", F.size("fields"))


@query("rk_17_path_search", GRAPH + r""", q AS (SELECT key, list_filter([CASE WHEN starts_with(lower(name), 'part') THEN 3 WHEN contains(lower(name), 'part') THEN 6 END,
  CASE WHEN lower(qualified_name) = 'part' THEN 1 WHEN starts_with(lower(qualified_name), 'part') THEN 4 WHEN contains(lower(qualified_name), 'part') THEN 7 END, CASE WHEN starts_with(path, 'part') THEN 5 WHEN contains(path, 'part') THEN 8 END], lambda x: x IS NOT NULL) AS r FROM nodes)
SELECT key, CAST(list_min(r) AS BIGINT) AS rank, CAST(len(r) AS INTEGER) AS fields FROM q WHERE len(r) > 0""")
def rk_17_path(spark, d):
    return graph.name_ranks(V.nodes(spark, d), "part").withColumn("fields", F.size("fields"))


@query("gr_02_resolve_symbol", GRAPH + " SELECT key, kind, path FROM nodes WHERE name IN ('cold widget') AND kind = 'function'")
def gr_02(spark, d):
    return graph.resolve(V.nodes(spark, d), name="cold widget", kind="function").select("key", "kind", "path")


@query("gr_03_resolve_file", GRAPH + " SELECT key, kind, name FROM nodes WHERE path = 'part/7'")
def gr_03(spark, d):
    return graph.resolve(V.nodes(spark, d), path="part/7").select("key", "kind", "name")


@query("gr_04_list_nodes", GRAPH + ", m AS (SELECT key FROM nodes WHERE kind = 'function' AND (path = 'orders' OR starts_with(path, 'orders/'))), h AS (SELECT count(*) AS n FROM m) SELECT key, n AS count, 20 + 30 < n AS truncated, CASE WHEN 20 + 30 < n THEN 50 END AS next_offset FROM (SELECT key FROM m ORDER BY key LIMIT 30 OFFSET 20), h")
def gr_04(spark, d):
    rows, head = graph.page(graph.resolve(V.nodes(spark, d), kind="function", under="orders").select("key"), ["key"], 20, 30)
    return rows.select("key", F.lit(head["count"]).cast("long").alias("count"), F.lit(head["truncated"]).alias("truncated"), F.lit(head["next_offset"]).cast("int").alias("next_offset"))


@query("sl_06_bounded_neighbours", GRAPH + ", s AS (SELECT DISTINCT relation, src AS key FROM edges WHERE dst = 'n:3' ORDER BY key, relation LIMIT 1024) SELECT relation, key FROM s WHERE relation = 'references' ORDER BY key, relation LIMIT 40")
def sl_06(spark, d):
    return graph.neighbours(V.edges(spark, d), "n:3", "incoming", ["references"], 40)


@query("gr_05_export", GRAPH + ", pg AS (SELECT key FROM (SELECT key FROM nodes ORDER BY key LIMIT 200 OFFSET 10) UNION SELECT key FROM nodes WHERE key IN ('n:1', 'p:5')) SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT key FROM pg) AND dst IN (SELECT key FROM pg)")
def gr_05(spark, d):
    return graph.export_page(V.nodes(spark, d), V.edges(spark, d), 10, 200, ["n:1", "p:5"])[1]


@query("gr_07_paths", CALLS + """, steps AS (SELECT DISTINCT * FROM call_graph), walk AS (
  SELECT 'p:1' AS key, ['p:1'] AS seen, 'p:1' AS path, 0 AS depth, ['p:1', ''] AS ord UNION ALL
  SELECT dst, list_append(seen, dst), path || '>' || relation || '>' || dst, depth + 1, ord || [dst, relation] FROM walk JOIN steps ON walk.key = src WHERE depth < 7 AND walk.key <> 'p:15' AND NOT list_contains(seen, dst)),
hit AS (SELECT path, depth, ord FROM walk WHERE key = 'p:15' ORDER BY ord LIMIT 25)
SELECT row_number() OVER (ORDER BY ord) - 1 AS place, path, CAST(depth AS BIGINT) AS depth FROM hit""")
def gr_07(spark, d):
    return graph.paths(V.call_graph(spark, d), "p:1", "p:15", 7, 25)


CHAIN_SQL = """, steps AS (SELECT src, dst, min(relation) AS relation FROM call_graph WHERE relation IN ('calls', 'possible-calls') GROUP BY ALL), walk AS (
  SELECT '{0}' AS key, ['{0}'] AS nodes, CAST([] AS VARCHAR[]) AS rels UNION ALL SELECT dst, list_append(nodes, dst), list_append(rels, relation) FROM walk JOIN steps ON walk.key = src WHERE len(rels) < 12 AND NOT list_contains(nodes, dst) AND walk.key <> '{1}'),
best AS (SELECT * FROM walk WHERE key = '{1}' ORDER BY len(rels), nodes, rels LIMIT 1)"""


@query("gr_08_shortest_chain", CALLS + CHAIN_SQL.format("p:2", "p:95") + " SELECT 'p:2' AS start, nodes[1] || array_to_string(list_transform(range(1, len(nodes)), lambda i: '>' || rels[i] || '>' || nodes[i + 1]), '') AS path, CAST(len(rels) AS BIGINT) AS depth FROM best")
def gr_08(spark, d):
    start = spark.createDataFrame([("p:2",)], "key string")
    return graph.shortest_chain(graph.call_edges(V.call_graph(spark, d)), start, "p:95", 12)


REACH = """, steps AS (SELECT DISTINCT {a} AS a, {b} AS b FROM call_graph WHERE relation IN ({rels})),
reach(key, depth) USING KEY (key) AS (SELECT '{start}', 0 UNION SELECT b, min(reach.depth + 1) FROM reach JOIN steps ON reach.key = a LEFT JOIN recurring.reach AS old ON old.key = b WHERE reach.depth < {most} AND old.key IS NULL GROUP BY b)
SELECT key, CAST(depth AS BIGINT) AS depth FROM reach"""


@query("gr_09_reachable_calls", CALLS + REACH.format(a="src", b="dst", rels="'calls', 'possible-calls'", start="p:3", most=12))
def gr_09(spark, d):
    return graph.distances(graph.call_edges(V.call_graph(spark, d)), spark.createDataFrame([("p:3",)], "key string"), 12)


@query("gr_10_impact_calls", CALLS + REACH.format(a="dst", b="src", rels="'calls', 'possible-calls', 'references'", start="p:5", most=8) + " WHERE depth > 0")
def gr_10(spark, d):
    return graph.impact(V.call_graph(spark, d), spark.createDataFrame([("p:5",)], "key string"), 8)


@query("gr_11_dead_calls", CALLS + "," + V.NODES_SQL + REACH.format(a="src", b="dst", rels="'calls'", start="p:3", most=6).replace("SELECT key, CAST(depth AS BIGINT) AS depth FROM reach", "SELECT key FROM nodes WHERE kind = 'function' AND key NOT IN (SELECT key FROM reach)"))
def gr_11(spark, d):
    calls = graph.call_edges(V.call_graph(spark, d), possible=False)
    return graph.dead(V.nodes(spark, d), calls, spark.createDataFrame([("p:3",)], "key string"), 6).select("key")


@query("gr_12_operational_role", CALLS + CHAIN_SQL.format("p:2", "p:95") + """, e AS (SELECT DISTINCT * FROM call_graph)
SELECT 'incoming' AS section, relation AS label, count(*) AS n FROM e WHERE dst = 'p:95' GROUP BY relation UNION ALL SELECT 'outgoing', relation, count(*) FROM e WHERE src = 'p:95' GROUP BY relation
UNION ALL SELECT 'caller', src, count(*) FROM e WHERE dst = 'p:95' AND relation LIKE '%calls' GROUP BY src UNION ALL SELECT 'callee', dst, count(*) FROM e WHERE src = 'p:95' AND relation LIKE '%calls' GROUP BY dst
UNION ALL SELECT 'entry chain', nodes[1] || array_to_string(list_transform(range(1, len(nodes)), lambda i: '>' || rels[i] || '>' || nodes[i + 1]), ''), len(rels) FROM best""")
def gr_12(spark, d):
    return graph.operational_role(V.call_graph(spark, d), "p:95", spark.createDataFrame([("p:2",)], "key string"), 12)


COMMUNITY_SQL = CALLS + "," + V.NODES_SQL + """, own AS (SELECT key, kind, path FROM nodes WHERE path = 'part' OR starts_with(path, 'part/')), e AS (
  SELECT DISTINCT * FROM call_graph WHERE relation = 'references' UNION SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' FROM lineitem),
ins AS (SELECT e.* FROM e WHERE src IN (SELECT key FROM own) AND dst IN (SELECT key FROM own)), links AS MATERIALIZED (SELECT src, dst FROM ins UNION SELECT dst, src FROM ins),
l(key, component) USING KEY (key) AS (SELECT src, src FROM links GROUP BY src UNION (SELECT links.src, min(l.component) FROM l JOIN links ON links.dst = l.key JOIN recurring.l AS old ON old.key = links.src WHERE l.component < old.component GROUP BY links.src)),
m0 AS (SELECT key, kind, path, coalesce(component, key) AS community FROM own LEFT JOIN l USING (key)), m AS (SELECT * FROM m0 WHERE community IN (SELECT community FROM m0 GROUP BY community HAVING count(*) >= 2)),
x AS (SELECT community, src, dst, relation FROM ins JOIN m ON src = m.key), deg AS (SELECT m.community, m.key, (SELECT count(*) FROM x WHERE x.src = m.key) + (SELECT count(*) FROM x WHERE x.dst = m.key AND x.src <> x.dst) AS n FROM m)
SELECT community, 'nodes' AS section, '' AS label, count(*) AS n FROM m GROUP BY community UNION ALL SELECT community, 'edges', '', count(*) FROM x GROUP BY community
UNION ALL SELECT community, 'relation', relation, count(*) FROM x GROUP BY ALL
UNION ALL SELECT community, 'incoming', relation, count(*) FROM e JOIN m ON dst = m.key WHERE src NOT IN (SELECT key FROM own) GROUP BY ALL
UNION ALL SELECT community, 'kind', kind, count(*) FROM m GROUP BY ALL UNION ALL SELECT community, 'path', 'part', count(*) FROM m GROUP BY ALL
UNION ALL SELECT community, 'representative', key, n FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, key) AS i FROM deg) WHERE i <= 5"""


@query("gr_13_communities", COMMUNITY_SQL)
def gr_13(spark, d):
    more = V.edges(spark, d).filter("relation = 'calls'")
    return graph.communities(V.nodes(spark, d), V.call_graph(spark, d).filter("relation = 'references'").unionByName(more), "part")


@query("gr_14_unresolved", "WITH " + V.UNRESOLVED_SQL + " SELECT source, relation, expression, reason FROM unresolved WHERE reason = 'ambiguous' AND relation = 'calls'")
def gr_14(spark, d):
    return V.unresolved(spark, d).filter("reason = 'ambiguous' AND relation = 'calls'")


@query("ag_04_unresolved_stats", "WITH " + V.UNRESOLVED_SQL + " SELECT reason, relation, count(*) AS n, count(DISTINCT source) AS sources FROM unresolved GROUP BY ALL")
def ag_04(spark, d):
    return V.unresolved(spark, d).groupBy("reason", "relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


NODE_SNAPSHOTS = """
n0 AS (SELECT 'o:' || o_orderkey AS key, o_orderstatus AS name FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01'), n1 AS (SELECT 'o:' || o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderstatus END AS name FROM orders WHERE o_orderpriority <> '5-LOW'),
e0 AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R'), e1 AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem)"""


@query("gr_16_node_difference", "WITH" + NODE_SNAPSHOTS + """, d AS ((SELECT * FROM e0 EXCEPT SELECT * FROM e1) UNION ALL (SELECT * FROM e1 EXCEPT SELECT * FROM e0))
SELECT key, 'added' AS change FROM n1 WHERE key NOT IN (SELECT key FROM n0) UNION ALL SELECT key, 'removed' FROM n0 WHERE key NOT IN (SELECT key FROM n1)
UNION ALL SELECT n0.key, 'metadata_changed' FROM n0 JOIN n1 USING (key) WHERE n0.name <> n1.name UNION ALL SELECT DISTINCT key, 'relationship_changed' FROM n0 JOIN n1 USING (key) JOIN d ON d.src = key""")
def gr_16(spark, d):
    o, lines = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    key = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("key")
    n0 = o.filter("o_orderdate < TIMESTAMP '1997-06-01'").select(key, F.col("o_orderstatus").alias("name"))
    n1 = o.filter("o_orderpriority <> '5-LOW'").select(key, F.when(F.col("o_orderstatus") == "P", "changed").otherwise(F.col("o_orderstatus")).alias("name"))
    e = lambda rows: rows.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("relation"))
    return graph.node_difference((n0, e(lines.filter("l_returnflag <> 'R'"))), (n1, e(lines)))


@query("gr_17_checked", GRAPH + """, bad AS (SELECT key, name FROM nodes UNION ALL SELECT 'p:' || p_partkey, p_brand FROM part WHERE p_size > 40), x AS (SELECT src, dst FROM edges UNION ALL SELECT 'o:' || l_orderkey, 'q:' || l_linenumber FROM lineitem)
SELECT 'conflict' AS problem, key, count(DISTINCT name) AS n FROM bad GROUP BY key HAVING count(DISTINCT name) > 1 UNION ALL SELECT 'missing', key, count(*) FROM (SELECT src AS key FROM x UNION ALL SELECT dst FROM x) WHERE key NOT IN (SELECT key FROM bad) GROUP BY key""")
def gr_17(spark, d):
    nodes = V.nodes(spark, d).select("key", "name").unionByName(V.table(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("name")))
    wrong = V.table(spark, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("q:"), F.col("l_linenumber").cast("string")).alias("dst"))
    return graph.checked(nodes, V.edges(spark, d).select("src", "dst").unionByName(wrong))


@query("gr_23_relationships", """
WITH e AS (SELECT 's:' || l_suppkey AS seed, 'outgoing' AS direction, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'possible-calls' END AS relation, 'p:' || l_partkey AS related, CASE WHEN l_linenumber > 1 THEN l_orderkey END AS site FROM lineitem),
g AS (SELECT seed, direction, relation, related, count(*) AS occurrences, list_sort(list_distinct(list(site) FILTER (site IS NOT NULL))) AS s FROM e GROUP BY ALL)
SELECT seed, direction, relation, related, occurrences, array_to_string(s[1:3], ',') AS sites, coalesce(len(s), 0) > 3 AS truncated, CASE WHEN relation LIKE '%possible%' THEN 'possible' ELSE 'definite' END AS certainty FROM g""".replace("array_to_string(s[1:3], ',')", "coalesce(array_to_string(s[1:3], ','), '')"))
def gr_23(spark, d):
    key = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    relation = F.when(F.col("l_returnflag") == "R", "calls").otherwise("possible-calls")
    edges = V.table(spark, d, "lineitem").select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), relation.alias("relation"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("site"))
    seeds = V.table(spark, d, "supplier").select(key("s", "s_suppkey").alias("key"))
    return graph.relationships(edges, seeds).withColumn("sites", F.array_join(F.transform("sites", lambda x: x.cast("string")), ","))


@query("gr_24_overlay_check", """
WITH a AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_linenumber = 1), x AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_linenumber = 2)
SELECT 'removed, not in base' AS problem, src, dst FROM (SELECT * FROM r EXCEPT SELECT * FROM a) UNION ALL SELECT 'added, in base', src, dst FROM (SELECT * FROM x INTERSECT SELECT * FROM a)""")
def gr_24(spark, d):
    lines = V.table(spark, d, "lineitem")
    of = lambda df: df.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("relation")).distinct()
    return graph.invalid_overlay(of(lines.filter("l_returnflag <> 'R'")), of(lines.filter("l_linenumber = 1")), of(lines.filter("l_linenumber = 2"))).drop("relation")


@query("gr_25_checksum", GRAPH + ", e AS (SELECT DISTINCT src, dst, relation FROM edges) SELECT count(*) AS n FROM e")
def gr_25(spark, d):
    """The checksum of the base with an overlay equals that of the compacted graph; its count is what SQL can tell."""
    base = V.edges(spark, d).distinct()
    gone, new = base.filter("relation = 'contains'"), base.filter("relation = 'contains'")
    compact = graph.overlay(base, gone, new)
    both = graph.checksum(base).join(graph.checksum(compact), ["n", "low", "high"])
    return both.select("n")


@query("gr_19_impact_in_order", CALLS + """, e AS (SELECT DISTINCT src, dst, relation FROM call_graph),
near AS (SELECT DISTINCT key, next, relation, CASE WHEN relation IN ('calls', 'possible-calls') THEN 1 ELSE 2 END AS class FROM (SELECT src AS key, dst AS next, relation FROM e UNION ALL SELECT dst, src, relation FROM e)),
walk AS (
  SELECT 'p:1' AS key, ['p:1'] AS seen, CAST([] AS STRUCT(class INT, key VARCHAR, relation VARCHAR)[]) AS trail
  UNION ALL SELECT next, list_append(seen, next), list_append(trail, {'class': class, 'key': next, 'relation': relation}) FROM walk JOIN near USING (key) WHERE len(trail) < 6 AND NOT list_contains(seen, next)),
first AS (SELECT key, trail FROM walk WHERE len(trail) > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(trail), trail) = 1)
SELECT row_number() OVER (ORDER BY len(trail), trail) - 1 AS place, key, len(trail)::BIGINT AS depth, trail[-1].relation AS relation FROM first QUALIFY place < 200""")
def gr_19(spark, d):
    """Held against a queue in tests/test_sections.py."""
    return graph.impact_in_order(V.call_graph(spark, d), spark.createDataFrame([("p:1",)], "key string"), 6, 200)


@query("gr_21_reversed_paths", CALLS + """, steps AS (SELECT DISTINCT * FROM call_graph), walk AS (
  SELECT 'p:15' AS key, ['p:15'] AS seen, 'p:15' AS path, 0 AS depth UNION ALL SELECT src, list_append(seen, src), src || '>' || relation || '>' || path, depth + 1 FROM walk JOIN steps ON walk.key = dst WHERE depth < 6 AND walk.key <> 'p:1' AND NOT list_contains(seen, src))
SELECT path, CAST(depth AS BIGINT) AS depth FROM walk WHERE key = 'p:1'""")
def gr_21(spark, d):
    """From the target back: the same paths, turned round."""
    back = V.call_graph(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return graph.paths(back, "p:15", "p:1", 6, 1000).select(F.array_join(F.reverse(F.split("path", ">")), ">").alias("path"), "depth")


@query("rk_20_centrality", CALLS + """, s AS (SELECT 1 AS query_id, 'p:' || p_partkey AS key, p_size / 100.0 AS base FROM part WHERE p_size <= 8), b AS (SELECT DISTINCT * FROM (SELECT src AS key, dst AS nx, relation FROM call_graph UNION ALL SELECT dst, src, relation FROM call_graph)),
d AS (SELECT s.key, CASE WHEN relation = 'calls' THEN 1.0 ELSE 0.6 END * (0.5 + o.base) AS raw FROM s JOIN b ON s.key = b.key JOIN s o ON o.key = nx WHERE nx <> s.key),
p AS (SELECT s.key, o.key AS ok, o.base, count(*) AS n FROM s JOIN (SELECT DISTINCT key, nx FROM b) x ON x.key = s.key JOIN (SELECT DISTINCT key, nx FROM b) y ON y.nx = x.nx JOIN s o ON o.key = y.key WHERE o.key <> s.key GROUP BY ALL),
r AS (SELECT key, sum(raw) AS raw FROM (SELECT key, raw FROM d UNION ALL SELECT key, 0.15 * least(n, 4) * (0.5 + base) FROM p UNION ALL SELECT key, 0 FROM s) GROUP BY key)
SELECT key, CAST(round(raw / (SELECT max(raw) FROM r), 6) AS DOUBLE) AS centrality FROM r""")
def rk_20(spark, d):
    seeds = V.table(spark, d, "part").filter("p_size <= 8").select(F.lit(1).alias("query_id"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_size") / 100.0).alias("base"))
    return graph.centrality_among(seeds, V.call_graph(spark, d)).select("key", F.round("centrality", 6).alias("centrality"))
