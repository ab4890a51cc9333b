"""Queries over the narrow budget, excerpts, inspections and assessments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import discovery, evidence
from cairnwork.plans import discovery_queries
from cairnwork.plans import views as V
from cairnwork.plans.base import query

MOST_OF_A_LANE = 40  # candidates that a lane offers


def lane_rows(spark, d):
    """Candidates of three lanes for every supplier, of its lines."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    lane = F.element_at(F.array(*map(F.lit, evidence.LANES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    start = F.when(p % 7 != 0, p % 60).cast("long")
    rows = V.table(spark, d, "lineitem").select(
        s.alias("query"), lane.alias("lane"), F.concat(F.lit("h"), (p % 40).cast("string")).alias("handle"),
        F.when(p % 9 == 0, "").otherwise(F.concat(F.lit(" Src/"), (p % 6).cast("string"), F.lit(".go"))).alias("path"),
        F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("Sym"), (p % 12).cast("string"))).alias("label"), start.alias("start_line"), (start + F.col("l_linenumber") % 4).alias("end_line"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    nth = F.row_number().over(W.partitionBy("query", "lane").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return rows.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= MOST_OF_A_LANE).drop("l_orderkey", "l_linenumber", "l_partkey")


@query("rk_25_narrow_budget", f"""WITH RECURSIVE cand AS (
  SELECT l_suppkey AS query, l_linenumber % 3 AS lane, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3 ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth, 'h' || l_partkey % 40 AS handle,
    CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'src/' || l_partkey % 6 || '.go' END AS path, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'sym' || l_partkey % 12 END AS label,
    CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 60 END AS s, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 60 + l_linenumber % 4 END AS e
  FROM lineitem QUALIFY nth <= {MOST_OF_A_LANE}),
c AS (SELECT query, lane, nth, struct_pack(handle, path, label, s, e) AS cd FROM cand),
step AS (
  SELECT query, 0 AS turn, [1, 1, 1]::BIGINT[] AS pos, 0 AS idle, CAST([] AS STRUCT(handle VARCHAR, path VARCHAR, label VARCHAR, s BIGINT, e BIGINT)[]) AS kept,
    -1 AS lane, 0::BIGINT AS nth, '' AS handle, '' AS verdict FROM (SELECT DISTINCT query FROM c)
  UNION ALL
  SELECT query, CASE WHEN cd IS NULL OR NOT dup THEN (turn + 1) % 3 ELSE turn END,
    CASE WHEN cd IS NULL THEN pos ELSE list_transform(pos, lambda x, i: x + CASE WHEN i = turn + 1 THEN 1 ELSE 0 END) END,
    CASE WHEN cd IS NULL THEN idle + 1 WHEN dup THEN idle ELSE 0 END, CASE WHEN cd IS NULL OR dup THEN kept ELSE list_append(kept, cd) END,
    turn, nth, cd.handle, CASE WHEN cd IS NULL THEN '' WHEN dup THEN 'suppressed' ELSE 'kept' END
  FROM (
    SELECT step.query, turn, pos, idle, kept, c.nth, c.cd, len(list_filter(kept, lambda k: k.handle = c.cd.handle OR k.path <> '' AND k.path = c.cd.path AND (
      CASE WHEN k.s IS NULL OR c.cd.s IS NULL THEN k.label <> '' AND k.label = c.cd.label
           ELSE c.cd.s <= k.e AND k.s <= c.cd.e AND (c.cd.s = k.s AND c.cd.e = k.e OR k.label <> '' AND k.label = c.cd.label) END))) > 0 AS dup
    FROM step LEFT JOIN c ON c.query = step.query AND c.lane = step.turn AND c.nth = step.pos[step.turn + 1] WHERE len(kept) < 12 AND idle < 3))
SELECT query, {list(evidence.LANES)}[lane + 1] AS lane, nth, handle, verdict, CASE WHEN verdict = 'kept' THEN len(kept) END AS pick FROM step WHERE verdict <> ''""")
def rk_25(spark, d):
    return evidence.narrow_budget(lane_rows(spark, d), 12)


@query("dq_01_narrow")
def dq_01_narrow(spark, d):
    """Held against plain loops in tests/test_evidence.py."""
    results, _ = discovery_queries.lanes(spark, d, "narrow")
    nodes = V.nodes(spark, d).select("key", F.coalesce("qualified_name", "name").alias("label"))
    rows = results.join(nodes, "key", "left").select(F.col("query_id").alias("query"), "lane", F.col("rank").cast("long").alias("nth"), F.col("key").alias("handle"), "path", "label", F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("long").alias("end_line"))
    return evidence.narrow_budget(rows, 10)


GO_SPACE = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{GO_SPACE}', ''), '{GO_SPACE}$', '')"


def cut_sql(most: int, ends: str, with_end: bool) -> str:
    """The longest head of whole characters in `most` bytes, found by counting bytes character by character."""
    klass = "".join("\\" + c if c in ".?}" else c for c in ends)
    head = TRIM(f"left(t, CAST((SELECT count(*) FROM (SELECT sum(strlen(x)) OVER (ORDER BY i) AS upto FROM (SELECT unnest(string_split(left(t, {most}), '')) AS x, unnest(range(1, {most} + 1)) AS i)) WHERE upto <= {most}) AS INT))")
    return f"""SELECT doc_id, CASE WHEN strlen(t) <= {most} THEN t WHEN regexp_matches(h, '[{klass}]') AND strlen(regexp_extract(h, '^((?s:.*))[{klass}]', 1)) >= {most // 2}
      THEN {TRIM(f"regexp_extract(h, '^((?s:.*){'' if with_end else ')'}[{klass}]{')' if with_end else ''}', 1)")} || '…' ELSE h || '…' END AS text
    FROM (SELECT doc_id, t, CASE WHEN strlen(t) > {most} THEN {head} END AS h FROM w)"""


@query("tx_18_excerpts", f"WITH w AS (SELECT doc_id, {TRIM("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM documents WHERE text IS NOT NULL) SELECT a.doc_id, a.text AS excerpt, b.text AS section FROM ("
       + cut_sql(700, "\n.!?; }", True) + ") a JOIN (" + cut_sql(1200, "\n.!? ", False) + ") b USING (doc_id)")
def tx_18(spark, d):
    text = F.col("text")
    return V.table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", evidence.compact(text).alias("excerpt"), evidence.compact(text, 1200, "\n.!? ", False).alias("section"))


def snapshot_chunks(spark, d):
    """(path, chunk_id, start_line, end_line, text): five lines a chunk, each beginning with the last line of the one before."""
    lines = F.split("text", "\n")
    chunks = V.files(spark, d).filter("text IS NOT NULL").select("path", lines.alias("lines"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lines) - 2) / 4), F.lit(0)))).alias("c"))
    start = F.col("c") * 4 + 1
    held = F.slice("lines", start.cast("int"), F.lit(5))
    return chunks.select("path", F.concat("path", F.lit("#"), F.col("c").cast("string")).alias("chunk_id"), start.cast("long").alias("start_line"), (start + F.size(held) - 1).cast("long").alias("end_line"), F.array_join(held, "\n").alias("text"))


@query("dq_05_inspected", """WITH f AS (SELECT doc_id AS request, concat_ws('/', source, lang, doc_id || '.txt') AS path, string_split(text, chr(10)) AS lines FROM documents),
a AS (SELECT request, CASE WHEN request % 50 = 7 THEN 'gone/' || path ELSE path END AS path, CASE WHEN request % 50 = 7 THEN NULL ELSE lines END AS lines, CASE WHEN request % 5 <= 0 THEN 1 ELSE request % 5 END AS s, request % 5 + request % 4 - 1 AS e FROM f),
b AS (SELECT *, greatest(s, e) AS e2, CASE WHEN lines IS NULL THEN 'no such path' WHEN greatest(s, e) > len(lines) THEN 'outside' END AS problem FROM a),
c AS (SELECT *, greatest(1, s - 2) AS lo, least(len(lines), e2 + 2) AS hi FROM b)
SELECT request, path, CASE WHEN problem IS NULL THEN lo END AS start_line, CASE WHEN problem IS NULL THEN hi END AS end_line, problem, CASE WHEN problem IS NULL THEN array_to_string(lines[lo:hi], chr(10)) END AS source FROM c""")
def dq_05(spark, d):
    n = F.col("doc_id")
    path = F.when(n % 50 == 7, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    asked = V.files(spark, d).select(n.alias("request"), path.alias("path"), (n % 5).alias("start_line"), (n % 5 + n % 4 - 1).alias("end_line"))
    return evidence.inspected(asked, snapshot_chunks(spark, d), 2)


MODES, KINDS, PROVIDERS = ["orient", "search", "inspect", "trace", "impact", "other"], ["function", "file", "", "interface", "route", "document", "variable"], ["exact", "symbol", "arcana", "source", "symbol"]
PATHS = ["src/a.go", "", "x/test/a_test.go", "include/a.h", "docs/readme.md", "svc/config.go", "web/api/x.go", "lib/b.hpp"]


def q(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CASES_SQL = ", ".join(f"('{g}', '{c}', '{s}', '{n}', '{r}')" for (g, c), (s, n, r) in evidence.ASSESSMENTS.items())


@query("dq_06_assessed", f"""WITH req AS (SELECT c_custkey AS request, {q(MODES)}[c_custkey % 6 + 1] AS mode, CASE WHEN c_custkey % 4 = 1 THEN 'narrow' ELSE 'balanced' END AS breadth,
  CASE WHEN c_custkey % 6 IN (3, 4) THEN c_custkey % 3 ELSE 0 END AS found, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS unresolved FROM customer),
i AS (SELECT o_custkey AS request, {q(PROVIDERS)}[o_orderkey % 5 + 1] AS provider, {q(KINDS)}[o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'n' ELSE '' END AS name, {q(PATHS)}[o_orderkey % 8 + 1] AS path,
  CASE WHEN o_orderkey % 4 = 0 THEN ' x ' ELSE ' ' END AS excerpt FROM orders),
s AS (SELECT request, count(*) AS n, count(DISTINCT path) FILTER (path <> '') AS paths,
  bool_or(name <> '' AND kind NOT IN ('file', 'document') OR kind IN ('function', 'interface') OR provider IN ('exact', 'source') AND path <> '') AS owner,
  bool_or(provider IN ('exact', 'source') OR trim(excerpt) <> '' OR kind = 'function') AS flow,
  bool_or(kind IN ('interface', 'route') OR path IN ('include/a.h', 'svc/config.go', 'web/api/x.go', 'lib/b.hpp')) AS public, bool_or(path = 'x/test/a_test.go') AS tests FROM i GROUP BY request),
a AS (SELECT req.*, coalesce(n, 0) + found AS items, coalesce(paths, 0) AS paths, coalesce(owner, false) AS owner, coalesce(flow, false) AS flow, coalesce(public, false) AS public, coalesce(tests, false) AS tests,
  CASE WHEN mode IN ('trace', 'impact') THEN 'expand' ELSE mode END AS grp FROM req LEFT JOIN s USING (request)),
cs AS (SELECT *, CASE WHEN items = 0 THEN 'none' WHEN grp = 'search' AND breadth = 'narrow' THEN CASE WHEN owner AND flow THEN 'narrow core' ELSE 'narrow' END
  WHEN grp = 'inspect' AND owner AND flow AND public AND tests THEN 'all' WHEN grp = 'inspect' AND owner AND flow THEN 'core' WHEN grp = 'expand' AND unresolved > 0 THEN 'gaps' ELSE 'some' END AS cse FROM a),
t AS (SELECT * FROM (VALUES {CASES_SQL}) v(grp, cse, status, next_action, reason))
SELECT request, items::BIGINT AS evidence_items, paths::BIGINT AS distinct_paths, array_to_string(list_filter([CASE WHEN owner THEN 'owner' END, CASE WHEN flow THEN 'control_flow' END, CASE WHEN public THEN 'public_boundary' END, CASE WHEN tests THEN 'tests' END], lambda x: x IS NOT NULL), ' ') AS observed,
  array_to_string(list_filter([CASE WHEN NOT owner THEN 'owner' END, CASE WHEN NOT flow THEN 'control_flow' END, CASE WHEN NOT public THEN 'public_boundary' END, CASE WHEN NOT tests THEN 'tests' END], lambda x: x IS NOT NULL), ' ') AS missing, status, next_action, reason FROM cs JOIN t USING (grp, cse)""")
def dq_06(spark, d):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    customers = V.table(spark, d, "customer")
    requests = customers.select(c.alias("request"), pick(MODES, c).alias("mode"), F.when(c % 4 == 1, "narrow").otherwise("balanced").alias("breadth"))
    counts = customers.select(c.alias("request"), F.when((c % 6).isin(3, 4), c % 3).otherwise(0).alias("found"), F.when(c % 7 == 0, 2).otherwise(0).alias("unresolved"))
    items = V.table(spark, d, "orders").select(
        F.col("o_custkey").alias("request"), pick(PROVIDERS, o).alias("provider"), pick(KINDS, o).alias("kind"), F.when(o % 3 == 0, "n").otherwise("").alias("name"),
        F.lit("").alias("qualified_name"), pick(PATHS, o).alias("path"), F.when(o % 4 == 0, " x ").otherwise(" ").alias("excerpt"), F.lit(False).alias("inspected"),
    )
    return evidence.assessed(requests, items, counts).withColumns({x: F.array_join(x, " ") for x in ("observed", "missing")})
