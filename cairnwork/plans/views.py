"""Views of the tables as what the operators take: documents with paths, queries, a property graph, judgments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text)"""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation), one row an occurrence."""
    def of(name: str, src: tuple[str, str], dst: tuple[str, str], relation: str) -> DataFrame:
        key = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
        return table(spark, sf_dir, name).select(key(*src).alias("src"), key(*dst).alias("dst"), F.lit(relation).alias("relation"))

    return reduce(DataFrame.unionByName, [
        of("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "contains"),
        of("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "references"),
        of("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "references"),
        of("orders", ("o", "o_orderkey"), ("c", "o_custkey"), "references"),
        of("lineitem", ("o", "l_orderkey"), ("p", "l_partkey"), "calls"),
        of("lineitem", ("s", "l_suppkey"), ("p", "l_partkey"), "possible-calls"),
    ])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, kind, name, path, qualified_name)"""
    def of(name: str, letter: str, column: str, label: str, kind: str) -> DataFrame:
        key = F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))
        shown, path = F.col(label).cast("string"), F.concat(F.lit(f"{name}/"), F.col(column).cast("string"))
        return table(spark, sf_dir, name).select(key.alias("key"), F.lit(kind).alias("kind"), shown.alias("name"), path.alias("path"), F.concat(F.lit(f"{name}::"), shown).alias("qualified_name"))

    return reduce(DataFrame.unionByName, [
        of("region", "r", "r_regionkey", "r_name", "repository"), of("nation", "n", "n_nationkey", "n_name", "module"),
        of("customer", "c", "c_custkey", "c_name", "type"), of("supplier", "s", "s_suppkey", "s_name", "type"),
        of("part", "p", "p_partkey", "p_name", "function"), of("orders", "o", "o_orderkey", "o_orderkey", "function"),
    ])


EDGES_SQL = """
edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS relation FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'references' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'references' FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'references' FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'possible-calls' FROM lineitem)"""

NODES_SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS key, 'repository' AS kind, r_name AS name, 'region/' || r_regionkey AS path, 'region::' || r_name AS qualified_name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'module', n_name, 'nation/' || n_nationkey, 'nation::' || n_name FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'type', c_name, 'customer/' || c_custkey, 'customer::' || c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'type', s_name, 'supplier/' || s_suppkey, 'supplier::' || s_name FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'function', p_name, 'part/' || p_partkey, 'part::' || p_name FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'function', CAST(o_orderkey AS VARCHAR), 'orders/' || o_orderkey, 'orders::' || o_orderkey FROM orders)"""

TERMS_SQL = r"""
runs AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS run FROM documents),
parted AS (
  SELECT doc_id, run, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(run,
    '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ') AS parts FROM runs),
toks AS (
  SELECT doc_id, lower(run) AS term FROM parted
  UNION ALL SELECT doc_id, lower(unnest(parts)) FROM parted WHERE len(parts) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl)"""


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation): calls among parts, made of their keys, with paths of many steps, loops and diamonds."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    n = parts.agg(F.count(F.lit(1)).alias("n"))
    key = lambda c: F.concat(F.lit("p:"), c.cast("string"))
    rows = parts.crossJoin(n).select("p", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    to = (F.col("p") * (F.col("k") + 2) + 7 * F.col("k") + 1) % F.col("n")
    return rows.select(key(F.col("p")).alias("src"), key(to).alias("dst"), F.element_at(F.array(*map(F.lit, ("calls", "possible-calls", "references"))), F.col("k") + 1).alias("relation"))


CALLS_SQL = """
call_graph AS (
  SELECT 'p:' || p_partkey AS src, 'p:' || ((p_partkey * (k + 2) + 7 * k + 1) % (SELECT count(*) FROM part)) AS dst, ['calls', 'possible-calls', 'references'][k + 1] AS relation
  FROM part, (SELECT unnest(range(0, 3)) AS k))"""


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, expression, reason): references of orders that no node answers."""
    o = table(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderstatus") == "F", "no-definition").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("external")
    relation = F.when(F.col("o_orderkey") % 3 == 0, "references").otherwise("calls")
    return o.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("source"), relation.alias("relation"), F.col("o_orderpriority").alias("expression"), reason.alias("reason"))


UNRESOLVED_SQL = """
unresolved AS (
  SELECT 'o:' || o_orderkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'references' ELSE 'calls' END AS relation, o_orderpriority AS expression,
         CASE o_orderstatus WHEN 'F' THEN 'no-definition' WHEN 'O' THEN 'ambiguous' ELSE 'external' END AS reason
  FROM orders)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): documents of two words or more as Markdown, every fifth line a heading of level 1 to 4."""
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", path.alias("path"), F.array_join(made, "\n").alias("text"))


MARKDOWN_SQL = """
markdown AS (
  SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN repeat('#', CAST((i - 1) % 4 + 1 AS INT)) || ' ' || x ELSE x END), chr(10)) AS text
  FROM documents WHERE text IS NOT NULL)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): benchmark texts, some with words that paths have."""
    more = F.when(F.col("item_id") % 3 == 0, " src1 en").when(F.col("item_id") % 3 == 1, " txt fr 12").otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", more).alias("text"))


ASKED_SQL = "asked AS (SELECT item_id AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' src1 en' WHEN 1 THEN ' txt fr 12' ELSE '' END AS text FROM benchmark)"


def exact_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): queries with signals of every kind, made of parts."""
    p = F.col("p_partkey").cast("string")
    forms = [
        F.concat(F.lit('show "'), "p_name", F.lit('" please in src1')), F.concat(F.lit("version v1."), F.col("p_size").cast("string"), F.lit(".0, of go1.2-rc1")),
        F.concat(F.lit("why ERR_CODE"), p, F.lit(" or 0x1F, (404) E_FAIL?")), F.concat(F.lit("server.port"), p, F.lit("=80 --db.host_name=x a.go=1")),
        F.concat(F.lit("open src/part_"), p, F.lit(".go and main.rs")), F.concat(F.lit("where is parseHTTP"), p, F.lit(" or snake_case_x")),
        F.lit("log.level: debug http://x.y log.level the and of"), F.concat(F.lit("unclosed \"quote and 'single word' `tick` "), p),
    ]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))


EXACT_SQL = """
exact_queries AS (
  SELECT p_partkey AS query_id, [
    'show "' || p_name || '" please in src1', 'version v1.' || p_size || '.0, of go1.2-rc1', 'why ERR_CODE' || p_partkey || ' or 0x1F, (404) E_FAIL?',
    'server.port' || p_partkey || '=80 --db.host_name=x a.go=1', 'open src/part_' || p_partkey || '.go and main.rs', 'where is parseHTTP' || p_partkey || ' or snake_case_x',
    'log.level: debug http://x.y log.level the and of', 'unclosed "quote and ''single word'' `tick` ' || p_partkey][p_partkey % 8 + 1] AS text FROM part)"""


#: What traces are tried on: the call graph of parts with relations, kinds and places of many sorts, by the parts' keys.
TRACE_RELATIONS = ["calls", "contains", "possible-calls", "reads", "imports", "calls-endpoint", "writes", "defines", "references"]
TRACE_PLACES = ["src/app/", "src/test/", "@builtin/", "svc/logging/", "@external/", "src/handle/", "src/net/"]
TRACE_KINDS = ["function", "parameter", "method", "type", "variable"]


def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, kind, name, path, qualified_name)"""
    p = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    qualified = F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("app."), F.regexp_replace("p_name", " ", "_"), (p % 97).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p:"), p.cast("string")).alias("key"), pick(TRACE_KINDS, p).alias("kind"), F.when(p % 10 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.concat(pick(TRACE_PLACES, p), F.lit("p"), p.cast("string"), F.lit(".go")).alias("path"), qualified.alias("qualified_name"),
    )


def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation)"""
    calls = call_graph(spark, sf_dir)
    n = F.substring("src", 3, 18).cast("long") * 7 + F.substring("dst", 3, 18).cast("long") * 3
    return calls.select("src", "dst", F.element_at(F.array(*map(F.lit, TRACE_RELATIONS)), (n % len(TRACE_RELATIONS) + 1).cast("int")).alias("relation"))


def trace_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, key, place, text): every hundredth part, with its own name asked for and now and then for tests."""
    p = F.col("p_partkey")
    text = F.concat(F.lit("How does app "), "p_name", F.lit(" write"), F.when(p % 300 == 0, " in its tests").otherwise(""))
    return table(spark, sf_dir, "part").filter(p % 100 == 0).select(p.alias("query"), F.concat(F.lit("p:"), p.cast("string")).alias("key"), F.lit(0).alias("place"), text.alias("text"))


TRACE_SQL = f"""{CALLS_SQL},
trace_nodes AS (
  SELECT 'p:' || p_partkey AS key, {TRACE_KINDS}[p_partkey % {len(TRACE_KINDS)} + 1] AS kind, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS name,
    {TRACE_PLACES}[p_partkey % {len(TRACE_PLACES)} + 1] || 'p' || p_partkey || '.go' AS path,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'app.' || replace(p_name, ' ', '_') || p_partkey % 97 END AS qualified_name FROM part),
trace_edges AS (
  SELECT DISTINCT src, dst, {TRACE_RELATIONS}[(src[3:]::BIGINT * 7 + dst[3:]::BIGINT * 3) % {len(TRACE_RELATIONS)} + 1] AS relation FROM call_graph),
trace_queries AS (
  SELECT p_partkey AS query, 'p:' || p_partkey AS key, 'How does app ' || p_name || ' write' || CASE WHEN p_partkey % 300 = 0 THEN ' in its tests' ELSE '' END AS text
  FROM part WHERE p_partkey % 100 = 0)"""
