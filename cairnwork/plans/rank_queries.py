"""Queries that rank symbols and evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import graph, ranking, vectors
from cairnwork.plans import views as V
from cairnwork.plans.base import query

#: Queries at hand for symbol scores.
SYMBOL_QUERIES = ["where is the cold widget", "nation_1", "customer::customer#000000001", "part/12", "small gadget request handler of part", "widget value", "NATION_2 region supplier calls"]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(SYMBOL_QUERIES)) + ") t(query_id, text))"


def asked(spark):
    return spark.createDataFrame(list(enumerate(SYMBOL_QUERIES)), "query_id int, text string")


SYMBOL_SQL = f"WITH {V.NODES_SQL}, {ASKED_SQL}, " + r"""
q AS (SELECT query_id, lower(text) AS q, list_filter(list_distinct_in_order, lambda x: x NOT IN ('about','after','also','and','are','does','explain','find','from','how','into','its','the','their','through','what','where','which','with')) AS terms FROM (
  SELECT query_id, text, list_reduce(list_transform(list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}_]+'), lambda x: strlen(x) >= 3), lambda x: [x]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_in_order FROM asked)),
n AS (SELECT key, kind, lower(name) AS name, lower(qualified_name) AS qual, lower(path) AS path, list_transform(list_filter(string_split_regex(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{Nd}]+'), lambda x: length(x) >= 2), lambda x: lower(x)) AS parts FROM nodes),
x AS (SELECT *, q = name AND strlen(name) >= 2 AS exact, len(terms) AS nt, name IN ('data','error','handle','request','response','result','source','value') AS gen,
  list_transform(terms, lambda t: CASE WHEN list_contains(parts, t) THEN 9 WHEN contains(name, t) THEN 6 WHEN contains(qual, t) THEN 3 WHEN contains(path, t) THEN 2 ELSE 0 END) AS hits FROM n, q),
y AS (SELECT *, len(list_filter(hits, lambda h: h > 0)) AS m, len(list_filter(hits, lambda h: h IN (2, 3))) AS cx,
  CASE WHEN strlen(name) >= 2 AND contains(q, name) AND (exact OR nt <= 3 OR len(parts) >= 2) AND (NOT gen OR exact) THEN 32 ELSE 0 END + CASE WHEN q = qual THEN 48 ELSE 0 END + CASE WHEN q = path THEN 48 ELSE 0 END + coalesce(list_sum(hits), 0) AS raw FROM x),
scored AS (SELECT query_id, key, CAST(raw + CASE WHEN m > 1 THEN (m - 1) * 4 ELSE 0 END + CASE WHEN nt > 1 THEN m / nt * 18 ELSE 0 END - CASE WHEN gen AND NOT exact AND nt >= 4 AND cx < 2 THEN 24 ELSE 0 END + CASE WHEN kind IN ('function', 'type', 'module') THEN 6 ELSE 0 END AS DOUBLE) AS score FROM y WHERE raw > 0)"""


@query("rk_11_symbol_scores", SYMBOL_SQL + " SELECT query_id, key, round(score, 6) AS score FROM scored WHERE score >= 9")
def rk_11(spark, d):
    return ranking.symbol_scores(V.nodes(spark, d), asked(spark)).withColumn("score", F.round("score", 6))


@query("rk_13_expanded", SYMBOL_SQL + f", {V.CALLS_SQL}, " + """seeds AS (SELECT query_id, key, score FROM scored WHERE score >= 9 AND starts_with(key, 'p:')), b AS (SELECT src AS k, dst AS nx, relation FROM call_graph UNION ALL SELECT dst, src, relation FROM call_graph)
SELECT query_id, nx AS key, round(max(score * 0.62 + CASE relation WHEN 'calls' THEN 8 WHEN 'references' THEN 4 ELSE 2 END), 6) AS score FROM seeds JOIN b ON key = k GROUP BY ALL""")
def rk_13(spark, d):
    seeds = ranking.symbol_scores(V.nodes(spark, d), asked(spark)).filter(F.col("key").startswith("p:"))
    return ranking.expanded(seeds, V.call_graph(spark, d), V.nodes(spark, d)).withColumn("score", F.round("score", 6))


@query("rk_12_scoped", """
WITH n AS (SELECT 'p:' || p_partkey AS key, CASE WHEN p_size % 5 = 0 THEN 'src/test/' ELSE 'src/' END || p_brand AS path, p_size AS s, p_size + p_partkey % 9 AS e FROM part), sc AS (SELECT 1 AS query_id, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS place, 'src/' || p_brand AS path, 5 AS a, 30 AS b FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER), 'src/test/' || p_brand, 20, 22 FROM (SELECT DISTINCT p_brand FROM part)),
t AS (SELECT query_id, max(place) AS k FROM sc GROUP BY 1)
SELECT query_id, key, CAST(max((k - place + 1) * 100 - CASE WHEN path LIKE '%/test%' THEN k * 100 ELSE 0 END) AS DOUBLE) AS score FROM sc JOIN n USING (path) JOIN t USING (query_id) WHERE e >= a AND s <= b GROUP BY ALL""")
def rk_12(spark, d):
    parts = V.table(spark, d, "part")
    path = F.concat(F.when(F.col("p_size") % 5 == 0, "src/test/").otherwise("src/"), "p_brand")
    nodes = parts.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.lit("function").alias("kind"), path.alias("path"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 9).alias("end_line"))
    brands = parts.select("p_brand").distinct().withColumn("place", F.row_number().over(W.orderBy("p_brand")))
    scopes = brands.select(F.lit(1).alias("query_id"), "place", F.concat(F.lit("src/"), "p_brand").alias("path"), F.lit(5).alias("start_line"), F.lit(30).alias("end_line"))
    scopes = scopes.unionByName(brands.select(F.lit(2).alias("query_id"), "place", F.concat(F.lit("src/test/"), "p_brand").alias("path"), F.lit(20).alias("start_line"), F.lit(22).alias("end_line")))
    none = spark.createDataFrame([], "query_id int, key string, score double")
    return ranking.scoped(scopes.select("query_id", "place", "path", F.col("start_line"), F.col("end_line")), nodes.withColumnRenamed("start_line", "start_line").withColumnRenamed("end_line", "end_line"), none)


PAIRS = [("a/b/c.go", "a/b/d.go"), ("a/b/c.go", "a/x/d.go"), ("a/b/c.go", "a/b/c.go"), ("c.go", "d.go"), ("x/c.go", "y/d.go"), ("a/b/c/d.go", "a/e.go"), ("", "a/b.go"), ("m.go", "a/n.go")]


@query("rk_14_module_proximity", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({v} AS DOUBLE))" for (a, b), v in zip(PAIRS, ("1.0", "0.5", "1.0", "1.0", "0.0", "1.0 / 3", "0.0", "0.0"), strict=True)) + ") t(a, b, near)")
def rk_14(spark, d):
    return spark.createDataFrame(PAIRS, "a string, b string").withColumn("near", ranking.proximity(F.col("a"), F.col("b")).cast("double"))


@query("rk_24_representatives", """
WITH r AS (SELECT o_custkey AS q, o_orderkey AS key, lower(o_orderpriority) AS path, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END AS beh, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
a AS (SELECT *, min(rank) OVER (PARTITION BY q, path) AS f FROM r), b AS (SELECT *, (SELECT rank FROM a y WHERE y.q = a.q AND y.path = a.path AND y.rank > y.f ORDER BY beh, rank LIMIT 1) AS sec FROM a),
c AS (SELECT *, CASE WHEN rank = f OR rank = sec THEN 0 ELSE 1 END AS tier FROM b)
SELECT q AS query_id, key, n AS rank FROM (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY tier, f, CASE WHEN tier = 0 AND rank <> f THEN 1 ELSE 0 END, rank) AS n FROM c) WHERE n <= 8""")
def rk_24(spark, d):
    o = V.table(spark, d, "orders")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "type").when(F.col("o_orderstatus") == "O", "function").otherwise("method")
    return ranking.diverse(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("path"), kind.alias("kind"), rank.alias("rank")), 8)


@query("rk_28_round_robin", """
WITH r AS (SELECT o_custkey AS query_id, o_orderstatus AS lane, o_orderkey, CAST(o_totalprice / 1000 AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS turn FROM orders),
u AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY turn, list_position(['O', 'F', 'P'], lane) ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT query_id, o_orderkey, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1000""")
def rk_28(spark, d):
    o = V.table(spark, d, "orders")
    rank = F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("lane"), "o_orderkey", F.bround(F.col("o_totalprice") / 1000).cast("long").alias("size"), rank.alias("rank"))
    return ranking.round_robin(rows, ["O", "F", "P"], "size", 1000).select("query_id", "o_orderkey", "used")


@query("rk_27_source_scores", """
SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 1 THEN 100 WHEN 2 THEN 84 + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 12 ELSE 0 END WHEN 3 THEN 98 WHEN 4 THEN greatest(48, 82 - (greatest(l_quantity, 1) - 1) * 7) WHEN 5 THEN CASE WHEN l_returnflag = 'R' THEN 96 ELSE 90 END WHEN 6 THEN 92 ELSE 70 END AS DOUBLE) AS score FROM lineitem""")
def rk_27(spark, d):
    fact = F.element_at(F.array(*map(F.lit, ("role subject", "role neighbour", "impact subject", "dependent", "chain", "unresolved owner", "unresolved"))), F.least(F.col("l_linenumber"), F.lit(7)).cast("int"))
    returned = F.col("l_returnflag") == "R"
    score = ranking.source_score(fact, F.col("l_quantity"), F.when(returned, "incoming").otherwise("outgoing"), F.when(F.col("l_linestatus") == "O", "possible").otherwise("definite"), returned)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.cast("double").alias("score"))


@query("rk_18_hybrid_seeds")
def rk_18(spark, d):
    """Symbol scores and vector neighbours of parts as one list; held against plain loops in tests/test_ranking.py."""
    nodes = V.nodes(spark, d)
    scored = ranking.symbol_scores(nodes, asked(spark))
    symbols = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))).filter("rank <= 256")
    v = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked_vectors = v.filter(F.col("vec_id") < len(SYMBOL_QUERIES)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    near = vectors.nearest(v, asked_vectors, 256).select(F.col("query_id").cast("int").alias("query_id"), F.concat(F.lit("p:"), F.col("vec_id").cast("string")).alias("key"), "rank", "score")
    return ranking.hybrid_base(symbols, near, nodes, asked(spark)).withColumn("base", F.round("base", 6))


@query("gr_22_adjacency_order", f"WITH {V.EDGES_SQL}, e AS (SELECT DISTINCT src, dst, relation FROM edges WHERE src = 's:3' OR dst = 's:3') SELECT relation, CASE WHEN src = 's:3' THEN dst ELSE src END AS key, row_number() OVER (ORDER BY CASE WHEN relation IN ('calls-endpoint', 'handled-by') THEN 0 WHEN relation LIKE '%calls' THEN 1 ELSE 2 END, CASE WHEN src = 's:3' THEN dst ELSE src END, relation) AS place FROM e")
def gr_22(spark, d):
    e = graph.distinct_edges(V.edges(spark, d)).filter("src = 's:3' OR dst = 's:3'")
    return graph.adjacency(e, "s:3")
