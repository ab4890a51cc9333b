"""Queries of composite discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import discovery, graph, sections, vectors
from cairnwork.plans import text_queries
from cairnwork.plans import views as V
from cairnwork.plans.base import query
from cairnwork.plans.storage import cut

GRAPH = f"WITH RECURSIVE {V.EDGES_SQL}, {V.NODES_SQL}"


def lanes(spark, d, breadth="balanced"):
    made = cut(sections.chunks(V.files(spark, d)).select("chunk_id", "path", "text"))
    queries = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit('where is "'), F.substring("text", 1, 60), F.lit('" or nation_1 cold widget')).alias("text"))
    return discovery.search(made, V.nodes(spark, d), queries, breadth=breadth)


@query("dq_01_search")
def dq_01(spark, d):
    """Held against plain loops in tests/test_discovery.py."""
    return lanes(spark, d)[0]


@query("dq_01_coverage")
def dq_01_coverage(spark, d):
    return lanes(spark, d)[1]


@query("rk_15_anchors", GRAPH + " SELECT key, row_number() OVER (ORDER BY p, path, key) AS place FROM (SELECT key, path, CASE WHEN path LIKE '%test%' OR path LIKE '%spec%' THEN 2 WHEN path LIKE '%doc%' THEN 3 WHEN kind IN ('module', 'function') THEN 1 ELSE 4 END AS p FROM nodes ORDER BY p, path, key LIMIT 500)")
def rk_15(spark, d):
    return discovery.anchors(V.nodes(spark, d), 500)


@query("dq_07_anchored", GRAPH + ", a AS (SELECT * FROM (VALUES ('p:3'), ('NATION_4'), ('cold widget'), ('part/5'), ('part::small widget'), ('no such')) t(anchor)), x AS (SELECT anchor, key FROM a JOIN nodes ON anchor = key) SELECT * FROM x UNION ALL SELECT DISTINCT anchor, key FROM a JOIN nodes ON anchor IN (name, qualified_name, path) WHERE anchor NOT IN (SELECT anchor FROM x)")
def dq_07(spark, d):
    asked = spark.createDataFrame([(a,) for a in ("p:3", "NATION_4", "cold widget", "part/5", "part::small widget", "no such")], "anchor string")
    return discovery.anchored(V.nodes(spark, d), asked)


DECLARED_SQL = "n AS (SELECT 'p:' || p_partkey AS key, ['function', 'type', 'field', 'module', 'other'][p_partkey % 5 + 1] AS kind, p_brand AS path, p_size AS s, p_size + p_partkey % 9 AS e FROM part), r AS (SELECT s_suppkey AS range_id, 'Brand#' || (s_suppkey % 25 + 1) AS path, 10 + s_suppkey % 20 AS a, 10 + s_suppkey % 20 + s_suppkey % 7 AS b FROM supplier)"


@query("rk_16_declarations", "WITH " + DECLARED_SQL + """, m AS (SELECT *, s = a AND e = b AS ex FROM r JOIN n USING (path) WHERE s <= b AND e >= a), k AS (SELECT *, bool_or(ex) OVER (PARTITION BY range_id) AS anyx FROM m)
SELECT range_id, key, row_number() OVER (PARTITION BY range_id ORDER BY CASE kind WHEN 'function' THEN 0 WHEN 'type' THEN 0 WHEN 'module' THEN 1 WHEN 'field' THEN 3 ELSE 2 END, e - s, key) AS place FROM k WHERE ex OR NOT anyx""")
def rk_16(spark, d):
    p = V.table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("function", "type", "field", "module", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    nodes = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), kind.alias("kind"), F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 9).alias("end_line"))
    k = F.col("s_suppkey")
    ranges = V.table(spark, d, "supplier").select(k.alias("range_id"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("path"), (10 + k % 20).alias("a"), (10 + k % 20 + k % 7).alias("b"))
    return discovery.declarations(ranges, nodes)


TRACE_PATHS = ["src/a.go", "src/test/a.go", "@builtin/x", "@external/y", "lib/b_test.go"]
RELATIONS = ["calls", "possible-calls", "handled-by", "reads", "implements", "references", "imports", "contains", "odd"]
NAMES = ["updateState", "sendPacket", "widgetHandler", "plain", "deleteAndCreate"]
pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
pick_sql = lambda xs, c: "[" + ", ".join(f"'{x}'" for x in xs) + f"][{c} % {len(xs)} + 1]"


@query("rk_23_impact_scores", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {pick_sql(NAMES, 'l_partkey')} AS name, {pick_sql(TRACE_PATHS, 'l_suppkey')} AS path, {pick_sql(RELATIONS, 'l_orderkey')} AS relation, l_linenumber AS depth FROM lineitem),
v AS (SELECT *, lower(name || ' q.' || name || ' ' || path || ' function ' || relation) AS v, replace(relation, 'possible-', '') AS b FROM r)
SELECT l_orderkey, l_linenumber, CAST(round(180 - (greatest(depth, 1) - 1) * 28 + 0.7 * CASE b WHEN 'handled-by' THEN 120 WHEN 'calls' THEN 105 WHEN 'reads' THEN 95 WHEN 'implements' THEN 80 WHEN 'references' THEN 55 WHEN 'imports' THEN 20 WHEN 'contains' THEN 8 ELSE 45 END
 + 18 * len(list_filter(['the', 'widget', 'state', 'src'], lambda t: contains(v, t))) + 10 * len(list_filter(['apply','buffer','clear','create','delete','despawn','insert','mutate','remove','spawn','sync','tombstone','update','write'], lambda t: contains(v, t)))
 + 4 * len(list_filter(['consume','dispatch','handle','packet','process','publish','receive','send'], lambda t: contains(v, t))) + CASE WHEN path LIKE '@builtin/%' THEN -140 WHEN path LIKE '@external/%' THEN -50 ELSE 0 END
 + CASE WHEN path LIKE '%/test/%' OR path LIKE '%\\_test.%' ESCAPE '\\' THEN -120 ELSE 12 END + CASE WHEN relation LIKE 'possible-%' THEN -24 ELSE 12 END, 6) AS DOUBLE) AS score FROM v""")
def rk_23(spark, d):
    name = pick(NAMES, F.col("l_partkey"))
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", name.alias("name"), F.concat(F.lit("q."), name).alias("qualified_name"), pick(TRACE_PATHS, F.col("l_suppkey")).alias("path"), F.lit("function").alias("kind"), pick(RELATIONS, F.col("l_orderkey")).alias("relation"), F.col("l_linenumber").alias("depth"))
    return discovery.impact_scores(rows, discovery.trace_terms(F.lit("the widget state of src in"))).select("l_orderkey", "l_linenumber", "score")


@query("pr_07_path_classes", "WITH " + text_queries.NAMED_SQL + " SELECT p_partkey, CASE WHEN path LIKE '%/test%' OR path LIKE '%/spec%' THEN 'test' WHEN lower(path) LIKE '%.md' OR path LIKE '%/docs/%' THEN 'document' WHEN lower(path) LIKE '%config%' OR lower(path) LIKE '%schema%' OR lower(path) LIKE '%route%' OR lower(path) LIKE '%contract%' THEN 'contract' ELSE 'file' END AS class FROM named")
def pr_07(spark, d):
    return text_queries.named(spark, d).select("p_partkey", discovery.path_class(F.col("path")).alias("class"))


@query("tx_19_rendered_terms", r"SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace('HTTPServer2Go' || p_name || 'IDs', '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM part")
def tx_19(spark, d):
    return V.table(spark, d, "part").select("p_partkey", discovery.rendered_terms(F.concat(F.lit("HTTPServer2Go"), "p_name", F.lit("IDs"))).alias("words"))


@query("tx_20_neighbourhoods", GRAPH + r""", el AS (SELECT * FROM nodes WHERE kind NOT IN ('repository')), e AS (SELECT DISTINCT * FROM edges),
b AS (SELECT src AS key, 'out' AS way, relation, dst AS other FROM e UNION ALL SELECT dst, 'in', relation, src FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY key, way ORDER BY relation, other) AS i, count(*) OVER (PARTITION BY key, way) AS n FROM b),
s AS (SELECT r.key, way, string_agg(relation || ' ' || name, '; ' ORDER BY i) || CASE WHEN max(n) > 12 THEN '; omitted ' || (max(n) - 12) ELSE '' END AS line FROM r JOIN nodes o ON other = o.key WHERE i <= 12 GROUP BY ALL)
SELECT el.key, kind || ' ' || name || ' ' || trim(regexp_replace(lower(regexp_replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) || chr(10) || 'path ' || path || coalesce(chr(10) || 'out ' || a.line, '') || coalesce(chr(10) || 'in ' || c.line, '') AS text
FROM el LEFT JOIN s a ON a.key = el.key AND a.way = 'out' LEFT JOIN s c ON c.key = el.key AND c.way = 'in'""")
def tx_20(spark, d):
    return discovery.neighbourhoods(V.nodes(spark, d), V.edges(spark, d))


@query("dq_10_grounded", "WITH" + text_queries.LINES_SQL + """, a AS (SELECT doc_id AS answer_id, 'see ' || source || '/' || lang || '/' || doc_id || '.txt:' || (doc_id % 40) || ' and ' || source || '/' || lang || '/' || doc_id || '.txt:1-' || (doc_id % 9) || ', none.go:3' AS text FROM documents),
c AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.[A-Za-z0-9]+:[0-9]+(?:-[0-9]+)?')) AS citation FROM a),
p AS (SELECT *, split_part(citation, ':', 1) AS path, CAST(split_part(split_part(citation, ':', 2), '-', 1) AS INTEGER) AS x, CAST(coalesce(nullif(split_part(split_part(citation, ':', 2), '-', 2), ''), split_part(split_part(citation, ':', 2), '-', 1)) AS INTEGER) AS y FROM c)
SELECT answer_id, citation, coalesce(x >= 1 AND x <= y AND y <= len(ls), false) AS grounded FROM p LEFT JOIN lines USING (path)""")
def dq_10(spark, d):
    docs = V.files(spark, d)
    k = F.col("doc_id")
    answers = docs.select(k.alias("answer_id"), F.concat(F.lit("see "), "path", F.lit(":"), (k % 40).cast("string"), F.lit(" and "), "path", F.lit(":1-"), (k % 9).cast("string"), F.lit(", none.go:3")).alias("text"))
    return discovery.grounded(answers, sections.file_lines(docs).filter("n_lines > 0"))


@query("sk_08_redacted", """SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '","text":{"bytes":' || strlen(text) || ',"sha256":"' || sha256(text) || '"}}' AS value FROM conversations WHERE text IS NOT NULL""")
def sk_08(spark, d):
    return discovery.redacted(V.table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "role", "text"), ["text"])


@query("ve_08_stale", "WITH h AS (SELECT vec_id AS key, 'm1' AS i, 64 AS d, sha256(CAST(label AS VARCHAR)) AS t FROM embeddings WHERE label <> 3), w AS (SELECT vec_id AS key, CASE WHEN label = 1 THEN 'm2' ELSE 'm1' END AS i, CASE WHEN label = 2 THEN 32 ELSE 64 END AS d, sha256(CASE WHEN label = 4 THEN 'x' ELSE CAST(label AS VARCHAR) END) AS t FROM embeddings WHERE label <> 5) SELECT coalesce(h.key, w.key) AS key, CASE WHEN h.key IS NULL THEN 'missing' WHEN w.key IS NULL THEN 'gone' WHEN h.i <> w.i THEN 'identity' WHEN h.d <> w.d THEN 'dims' ELSE 'text' END AS why FROM h FULL JOIN w ON h.key = w.key WHERE h.key IS NULL OR w.key IS NULL OR h.i <> w.i OR h.d <> w.d OR h.t <> w.t")
def ve_08(spark, d):
    v, label = V.table(spark, d, "embeddings"), F.col("label")
    text = label.cast("string")
    held = v.filter("label <> 3").select(F.col("vec_id").alias("key"), F.lit("m1").alias("identity"), F.lit(64).alias("dims"), F.sha2(text, 256).alias("text_hash"))
    now = v.filter("label <> 5").select(F.col("vec_id").alias("key"), F.when(label == 1, "m2").otherwise("m1").alias("identity"), F.when(label == 2, 32).otherwise(64).alias("dims"), F.sha2(F.when(label == 4, "x").otherwise(text), 256).alias("text_hash"))
    return discovery.stale(held, now)


@query("ve_04_cache_keys", "SELECT doc_id, sha256('model' || chr(0) || '512' || chr(0) || 'query' || chr(0) || coalesce(text, '')) AS cache_key FROM documents")
def ve_04(spark, d):
    return V.table(spark, d, "documents").select("doc_id", vectors.cache_key(F.lit("model"), F.lit(512), F.lit("query"), F.col("text")).alias("cache_key"))


@query("ve_07_nearest_among", """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), m AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM embeddings, q WHERE label IN (1, 2))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m) WHERE rank <= 5""")
def ve_07(spark, d):
    v = V.table(spark, d, "embeddings")
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.nearest(v.filter("label IN (1, 2)").select("vec_id", F.col("embedding").alias("v")), queries, 5)


@query("ve_05_windows", """WITH q AS (SELECT item_id AS query_id, list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS tokens FROM benchmark), n AS (SELECT *, CAST(ceil(len(tokens) / 16) AS INT) AS n FROM q WHERE len(tokens) > 0),
w AS (SELECT query_id, i::INT AS part, 'split window ' || i || '/' || n AS label, tokens[(i - 1) * 16 + 1 : i * 16] AS tokens FROM n, unnest(range(1, n + 1)) r(i) WHERE n > 1)
SELECT query_id, part, label, array_to_string(tokens, ' ') AS text FROM w UNION ALL SELECT query_id, 0, 'full query', array_to_string(tokens, ' ') FROM n""")
def ve_05(spark, d):
    words = F.filter(F.split("text", r"[\t\n\x0b\f\r ]+"), lambda x: x != "")
    queries = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("tokens"))
    return vectors.windows(queries, mode="quality").withColumn("text", F.array_join("tokens", " ")).drop("tokens")


@query("ve_05_pooled", """WITH p AS (SELECT (vec_id - vec_id % 100) AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 < 3),
m AS (SELECT query_id, vec_id, max(round(list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6)) AS score FROM embeddings, p GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m) WHERE rank <= 10""")
def ve_05_pooled(spark, d):
    """Each hundredth vector and the two after it are a query's three windows."""
    v, n = V.table(spark, d, "embeddings"), F.col("vec_id")
    parts = v.filter(n % 100 < 3).select((n - n % 100).alias("query_id"), (n % 100).alias("part"), F.col("embedding").alias("q"))
    return vectors.nearest_to_parts(v.select("vec_id", F.col("embedding").alias("v")), parts, 10)


@query("dq_02_orient", GRAPH + """, asked AS (SELECT 0::BIGINT AS query, '' AS text UNION ALL SELECT r_regionkey + 1, r_name FROM region),
an AS (SELECT key, row_number() OVER (ORDER BY p, path, key) AS place FROM (SELECT key, path, CASE WHEN path LIKE '%test%' OR path LIKE '%spec%' THEN 2 WHEN path LIKE '%doc%' THEN 3 WHEN kind IN ('module', 'function') THEN 1 ELSE 4 END AS p FROM nodes ORDER BY p, path, key LIMIT 8)),
found AS (SELECT 0::BIGINT AS query, key, place FROM an UNION ALL SELECT n_regionkey + 1, 'n:' || n_nationkey, n_nationkey FROM nation),
sym AS (SELECT query, 'symbol' AS lane, row_number() OVER (PARTITION BY query ORDER BY place, key) AS rank, key AS anchor, kind, 'symbol or contract' AS reason FROM found JOIN nodes USING (key) QUALIFY rank <= 4),
src AS (SELECT query, 'source' AS lane, rank, path AS anchor, CASE WHEN path LIKE '%config%' THEN 'contract' ELSE 'file' END AS kind, 'file of the snapshot' AS reason FROM asked, (SELECT path, row_number() OVER (ORDER BY path) AS rank FROM (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path FROM documents WHERE coalesce(text, '') <> '') QUALIFY rank <= 4)),
s1 AS (SELECT query, 0 AS l, rank, anchor, m AS i, ['inspect', 'trace'][m + 1] AS kind, ['inspect the evidence of this anchor', 'expand bounded structural paths'][m + 1] AS reason FROM sym, (VALUES (0), (1)) v(m) WHERE rank <= 2),
s2 AS (SELECT query, 1, rank, anchor, 0, 'inspect', 'inspect the evidence of this anchor' FROM src WHERE rank <= 4 - (SELECT count(*) FROM s1 WHERE s1.query = src.query)),
s3 AS (SELECT query, 2, 1, '', 0, 'search', 'search for a symbol, contract, behaviour or literal' FROM asked WHERE text = ''),
sug AS (SELECT query, 'suggestion' AS lane, row_number() OVER (PARTITION BY query ORDER BY l, rank, i) AS rank, anchor, kind, reason FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3))
FROM sym UNION ALL FROM src UNION ALL FROM sug""")
def dq_02(spark, d):
    nodes = V.nodes(spark, d)
    asked = V.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("query"), F.col("r_name").alias("text")).unionByName(spark.range(1).selectExpr("id AS query", "'' AS text"))
    nations = V.table(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("query"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("long").alias("place"))
    found = discovery.anchors(nodes, 8).select(F.lit(0).cast("long").alias("query"), "key", "place").unionByName(nations)
    return discovery.oriented(found, asked, nodes, V.files(spark, d), 4)


@query("gr_27_closure", f"WITH RECURSIVE {V.CALLS_SQL}" + """, steps AS (SELECT DISTINCT dst AS a, src AS b FROM call_graph WHERE relation = 'calls'), fwd AS (SELECT DISTINCT src AS a, dst AS b FROM call_graph WHERE relation = 'calls'),
em(key, depth) USING KEY (key) AS (SELECT 'p:1', 0 UNION SELECT b, min(em.depth + 1) FROM em JOIN steps ON em.key = a LEFT JOIN recurring.em AS old ON old.key = b WHERE em.depth < 5 AND old.key IS NULL GROUP BY b),
cx AS (SELECT DISTINCT b AS key FROM em JOIN fwd ON em.key = a WHERE b NOT IN (SELECT key FROM em)) SELECT key, 'emit' AS part FROM em UNION ALL SELECT key, 'context' FROM cx""")
def gr_27(spark, d):
    calls = V.call_graph(spark, d).filter("relation = 'calls'")
    return graph.closure(calls, spark.createDataFrame([("p:1",)], "key string"), 5)


@query("st_04_sync_decisions", GRAPH + """, e AS (SELECT DISTINCT src, dst, relation FROM edges), less AS (SELECT * FROM e WHERE relation <> 'contains'), k AS (SELECT key FROM nodes), without AS (SELECT key FROM k WHERE key <> 'n:1'),
d AS (SELECT EXISTS (FROM (SELECT * FROM e EXCEPT SELECT * FROM less) UNION ALL FROM (SELECT * FROM less EXCEPT SELECT * FROM e)) AS edges_differ, EXISTS (FROM (SELECT key FROM k EXCEPT SELECT key FROM without)) AS nodes_differ)
SELECT 'fresh' AS case_name, 'rebuild' AS decision UNION ALL SELECT 'same', CASE WHEN EXISTS (FROM (SELECT * FROM e EXCEPT SELECT * FROM e)) THEN 'overlay' ELSE 'existing' END
UNION ALL SELECT 'edges', CASE WHEN edges_differ THEN 'overlay' ELSE 'existing' END FROM d UNION ALL SELECT 'nodes', CASE WHEN nodes_differ THEN 'rebuild' ELSE 'existing' END FROM d""")
def st_04(spark, d):
    nodes, edges = V.nodes(spark, d).select("key"), cut(V.edges(spark, d).distinct())
    less = edges.filter("relation <> 'contains'")
    found = [("fresh", discovery.sync_decision(False, nodes, nodes, edges, edges)), ("same", discovery.sync_decision(True, nodes, nodes, edges, edges)), ("edges", discovery.sync_decision(True, nodes, nodes, edges, less)), ("nodes", discovery.sync_decision(True, nodes, nodes.filter("key <> 'n:1'"), edges, edges))]
    return spark.createDataFrame(found, "case_name string, decision string")


@query("ag_02_declaration_vocabulary", r"""
WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#|--|/\*|\*|<!--)')) AS ls FROM documents),
h0 AS (SELECT doc_id, path, ls, list_transform(range(1, least(6, len(ls)) + 1), lambda i: strlen(array_to_string(ls[1:i], chr(10)))) AS sizes FROM f),
h AS (SELECT doc_id, path, array_to_string(ls[1:least(6, coalesce(list_min(list_transform(sizes, lambda z, i: CASE WHEN z >= 768 THEN i END)), 6))], chr(10)) AS head FROM h0),
runs AS (SELECT doc_id, unnest(list_filter(string_split_regex(path || ' ' || head, '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS run FROM h WHERE strlen(head) <= 768),
parted AS (SELECT doc_id, run, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(run, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ') AS parts FROM runs),
toks AS (SELECT doc_id, lower(run) AS term FROM parted UNION SELECT doc_id, lower(unnest(parts)) FROM parted WHERE len(parts) > 1)
SELECT doc_id, count(DISTINCT term) AS n_terms FROM toks GROUP BY doc_id""")
def ag_02(spark, d):
    files = V.files(spark, d).withColumn("head", T.declaration_header(F.col("text")))
    rows = files.filter(F.octet_length(T.declaration_header(F.col("text"), cut=False)) <= 768)
    return rows.select("doc_id", F.size(T.token_set(F.concat_ws("\n", "path", "head"))).cast("long").alias("n_terms"))
