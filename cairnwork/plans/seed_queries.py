"""Queries over what a graph says of seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import graph, seeds
from cairnwork.plans import views as V
from cairnwork.plans.base import query

SEEDS_SQL = f"""WITH RECURSIVE {V.CALLS_SQL},
seeds AS (SELECT p_partkey AS query, place, 'p:' || (p_partkey + add) AS key FROM part, (VALUES (0, 0), (1, 1), (2, 3), (3, 7)) o(place, add) WHERE p_partkey % 100 = 0),
keys AS (SELECT DISTINCT key AS seed FROM seeds),
un AS (SELECT 'p:' || o_orderkey % 211 AS seed, CASE WHEN o_orderkey % 3 = 0 THEN 'references' ELSE 'calls' END AS relation, o_orderpriority AS expression,
  CASE o_orderstatus WHEN 'F' THEN 'no-definition' WHEN 'O' THEN 'ambiguous' ELSE 'external' END AS reason FROM orders),
e AS (SELECT DISTINCT * FROM call_graph),
role AS (
  SELECT dst AS seed, 'incoming' AS direction, src AS key, relation FROM e JOIN keys ON dst = seed WHERE relation <> 'references'
  UNION ALL SELECT src, 'outgoing', dst, relation FROM e JOIN keys ON src = seed WHERE relation <> 'references'),
back(seed, key, depth) AS (SELECT seed, seed, 0 FROM keys UNION SELECT seed, src, depth + 1 FROM back JOIN e ON dst = key WHERE depth < 4),
near AS (SELECT seed, key, min(depth) AS depth FROM back GROUP BY ALL HAVING min(depth) > 0),
steps AS (SELECT src, dst, min(relation) AS relation FROM e WHERE relation <> 'references' GROUP BY ALL),
walk AS (
  SELECT seed AS start, seed AS key, [seed] AS nodes, CAST([] AS VARCHAR[]) AS rels FROM keys WHERE seed IN (SELECT key FROM seeds WHERE place < 3)
  UNION ALL SELECT start, dst, list_append(nodes, dst), list_append(rels, relation) FROM walk JOIN steps ON src = key WHERE len(rels) < 8 AND NOT list_contains(nodes, dst)),
pairs AS (SELECT a.query, a.place, a.key AS start, b.place AS towards, b.key AS target FROM seeds a JOIN seeds b ON a.query = b.query AND a.place <> b.place AND a.place < 3 AND b.place < 3),
chain AS (SELECT start, key AS target, nodes, rels FROM walk WHERE len(rels) > 0 QUALIFY row_number() OVER (PARTITION BY start, key ORDER BY len(rels), nodes, rels) = 1)
"""


def made(spark, d):
    p = F.col("p_partkey")
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("add")) for i, n in enumerate((0, 1, 3, 7)))))
    rows = V.table(spark, d, "part").filter(p % 100 == 0).select(p.alias("query"), places.alias("x"))
    own = rows.select("query", "x.place", F.concat(F.lit("p:"), (F.col("query") + F.col("x.add")).cast("string")).alias("key"))
    unresolved = V.unresolved(spark, d).withColumn("source", F.concat(F.lit("p:"), (F.substring("source", 3, 18).cast("long") % 211).cast("string")))
    return V.call_graph(spark, d), unresolved, own


@query("gr_29_seed_evidence", SEEDS_SQL + """, told AS (
  SELECT seed, 'operational_role' AS kind, row_number() OVER (PARTITION BY seed ORDER BY direction, key, relation) AS nth, direction || ' ' || relation || ' ' || key AS label FROM role QUALIFY nth <= 16
  UNION ALL SELECT seed, 'impact', row_number() OVER (PARTITION BY seed ORDER BY depth, key) AS nth, depth || ' ' || key FROM near QUALIFY nth <= 12
  UNION ALL SELECT seed, 'unresolved', row_number() OVER (PARTITION BY seed ORDER BY relation, expression, reason) AS nth, relation || ' ' || expression || ' ' || reason FROM un JOIN keys USING (seed) QUALIFY nth <= 8)
SELECT query, place, kind, nth, label FROM seeds JOIN told ON seed = key
UNION ALL SELECT query, place, 'call_chain', towards, nodes[1] || array_to_string(list_transform(range(1, len(nodes)), lambda i: '>' || rels[i] || '>' || nodes[i + 1]), '') FROM pairs JOIN chain USING (start, target)""")
def gr_29(spark, d):
    return seeds.evidence(*made(spark, d))


@query("gr_29_dependents", SEEDS_SQL + """SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY depth, key) AS nth, key, depth::INT AS depth, count(*) OVER (PARTITION BY seed) > 12 AS truncated FROM near QUALIFY nth <= 12""")
def gr_29_dependents(spark, d):
    edges, _, own = made(spark, d)
    return seeds.dependents(edges, own)


@query("gr_29_reached_by_all", f"""WITH RECURSIVE {V.CALLS_SQL}, e AS (SELECT DISTINCT src, dst FROM call_graph), reach(seed, key, depth) AS (
  SELECT 'p:' || p_partkey, 'p:' || p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT seed, dst, depth + 1 FROM reach JOIN e ON src = key WHERE depth < 5)
SELECT seed, key, min(depth)::INT AS depth FROM reach GROUP BY ALL""")
def gr_29_reached(spark, d):
    own = V.table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"))
    places = seeds.numbered(own)
    return seeds.told(seeds.reached(V.call_graph(spark, d).select(F.col("src").alias("key"), F.col("dst").alias("next")), places, 5), places)
