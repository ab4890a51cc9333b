"""Queries over traces: walks of many seeds, their scores and the choice among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import discovery, graph, traces
from cairnwork.plans import views as V
from cairnwork.plans.base import query

CONTEXT = "('contains', 'defines', 'imports')"
WORDS = lambda words, n: " + ".join(f"CASE WHEN contains(v, '{w}') THEN {n} ELSE 0 END" for w in words)
RELATION_CASES = " ".join(f"WHEN r IN ({', '.join(repr(x) for x in names.split())}) THEN {score}" for score, names in discovery.RELATION_SCORES.items())
TEST_PATH = "(contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '_test.') OR contains(path, '/spec/'))"

#: All simple paths of one to three steps from every seed, with what each node and each relation is worth on it.
PATHS_SQL = f"""WITH RECURSIVE {V.TRACE_SQL},
walk AS (
  SELECT query, key, [key] AS nodes, CAST([] AS VARCHAR[]) AS relations FROM trace_queries
  UNION ALL SELECT query, dst, list_append(nodes, dst), list_append(relations, relation) FROM walk JOIN trace_edges ON src = key
  WHERE len(relations) < 3 AND NOT list_contains(nodes, dst)),
paths AS (SELECT query, nodes, relations, row_number() OVER (PARTITION BY query ORDER BY nodes, relations) AS nth FROM walk WHERE len(relations) > 0),
terms AS (
  SELECT query, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: strlen(x) >= 3))) AS term, contains(lower(text), 'test') AS asks_tests
  FROM trace_queries),
held AS (
  SELECT *, CASE WHEN qualified_name <> '' THEN qualified_name WHEN name <> '' THEN name ELSE path END AS label,
    lower(name || ' ' || qualified_name || ' ' || path || ' ' || kind) AS v, {TEST_PATH} AS test,
    CASE WHEN path[1:9] = '@builtin/' THEN -140 WHEN path[1:10] = '@external/' THEN -50 ELSE 0 END AS place FROM trace_nodes),
worth AS (
  SELECT query, h.key, 18 * count(*) FILTER (contains(v, term)) + any_value({WORDS(discovery.CHANGES, 10)} + {WORDS(discovery.BEHAVIOURS, 4)}
    + place + CASE WHEN test THEN -120 ELSE 0 END) AS worth
  FROM (SELECT DISTINCT query, unnest(nodes) AS key FROM paths) JOIN held h USING (key) JOIN terms USING (query) GROUP BY query, h.key),
begun AS (
  SELECT *, coalesce(list_position(list_transform(relations, lambda r: r IN {CONTEXT}), false) - 1, len(relations)) AS begins FROM paths),
on_path AS (
  SELECT query, nth, begins, len(relations) AS steps, unnest(range(0, len(nodes))) AS i, unnest(nodes) AS key, unnest(list_append(relations, '')) AS relation FROM begun),
facts AS (
  SELECT o.*, h.*, w.worth, replace(o.relation, 'possible-', '') AS r FROM on_path o JOIN held h USING (key) JOIN worth w ON w.query = o.query AND w.key = o.key),
scored AS (
  SELECT query, nth, any_value(steps) AS steps, min(begins) AS begins,
    bool_or(i < steps AND r NOT IN {CONTEXT}) AS behaves, bool_or(test) AS has_test, bool_or(test AND i = begins) AS starts_in_test,
    any_value(steps) = 1 AND bool_or(i = steps AND place <= -100) AS intrinsic,
    bool_or(i > begins AND test) AND NOT bool_or(test AND i = begins) AS enters_tests,
    bool_or(i > begins AND (contains(lower(path || ' ' || qualified_name), '/logging/') OR contains(lower(path || ' ' || qualified_name), 'logger'))) AS diagnostic,
    bool_or(i = steps AND kind IN ('parameter', 'variable')) AND bool_or(i = steps - 1 AND r = 'reads') AS merely_read,
    sum(CASE WHEN i = begins THEN 5.0 * worth WHEN i > begins THEN 0.25 * worth ELSE 0 END)::DOUBLE AS of_nodes,
    sum(CASE WHEN i < steps AND r NOT IN {CONTEXT} THEN (CASE {RELATION_CASES} ELSE 45 END) * CASE WHEN i = begins THEN 0.7 ELSE 0.4 END ELSE 0 END)::DOUBLE AS of_relations,
    CASE WHEN min(begins) > 0 THEN max(label) FILTER (i = 0) || ' member ' ELSE '' END
      || string_agg(label || CASE WHEN i < steps THEN ' --' || relation || '→ ' ELSE '' END, '' ORDER BY i) FILTER (i >= begins) AS summary,
    string_agg(lower(label) || '>' || lower(relation) || '>', '|' ORDER BY i) FILTER (i >= begins) AS signature,
    lower(max(label) FILTER (i = begins)) AS entry
  FROM facts GROUP BY query, nth),
told AS (
  SELECT *, round(of_nodes + of_relations - CASE WHEN diagnostic THEN 60 ELSE 0 END - CASE WHEN enters_tests THEN 160 ELSE 0 END
    - CASE WHEN merely_read THEN 70 ELSE 0 END - CASE WHEN NOT behaves THEN 100 ELSE 0 END - 2 * (steps - begins), 6) AS score,
    (SELECT bool_or(asks_tests) FROM terms t WHERE t.query = scored.query) AS asks_tests FROM scored),
judged AS (SELECT *, bool_or(behaves) OVER (PARTITION BY query) AS any_behaves, bool_or(behaves AND NOT has_test) OVER (PARTITION BY query) AS in_production FROM told),
kept AS (
  SELECT * FROM judged WHERE NOT (in_production AND NOT asks_tests AND has_test AND NOT starts_in_test) AND NOT intrinsic AND (behaves OR NOT any_behaves)),
alone AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query, signature ORDER BY score DESC, steps, summary, nth) = 1),
few AS (SELECT * FROM alone QUALIFY row_number() OVER (PARTITION BY query, entry ORDER BY score DESC, steps, summary, nth) <= 2)
"""


def simple_paths(spark, d):
    """(query, nth, nodes, relations) of every seed's simple paths of one to three steps."""
    from pyspark.sql import Window as W

    steps = V.trace_edges(spark, d).distinct()
    at = V.trace_queries(spark, d).select("query", "key", F.array("key").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found = None
    for _ in range(3):
        at = at.join(steps, F.col("key") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        at = at.select("query", F.col("dst").alias("key"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"))
        found = at if found is None else found.unionByName(at)
    return found.select("query", F.row_number().over(W.partitionBy("query").orderBy("nodes", "relations")).cast("long").alias("nth"), "nodes", "relations")


def told(spark, d):
    return traces.scored(traces.described(simple_paths(spark, d), V.trace_nodes(spark, d)), V.trace_queries(spark, d))


@query("rk_22_path_scores", PATHS_SQL + "SELECT query, nth, score, summary, entry, behaves, intrinsic, has_test, starts_in_test FROM told")
def rk_22_scores(spark, d):
    return told(spark, d).select("query", "nth", "score", "summary", "entry", "behaves", "intrinsic", "has_test", "starts_in_test")


@query("rk_22_chosen_paths", PATHS_SQL + "SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, steps, summary, nth) AS rank, score, summary FROM few QUALIFY rank <= 6")
def rk_22_chosen(spark, d):
    return traces.chosen(told(spark, d), 6).select("query", "rank", "score", "summary")


def flat(paths):
    return paths.withColumns({c: F.array_join(c, ">") for c in ("nodes", "relations", "directions") if c in paths.columns})


@query("gr_18_traces")
def gr_18(spark, d):
    return flat(traces.walked(V.trace_queries(spark, d), V.trace_nodes(spark, d), V.trace_edges(spark, d), 4, 12))


@query("gr_18_traces_to_targets")
def gr_18_targets(spark, d):
    starts = V.trace_queries(spark, d)
    targets = starts.select("query", F.explode(F.array(F.col("query") + 1, F.col("query") + 3)).alias("p")).select("query", F.concat(F.lit("p:"), F.col("p").cast("string")).alias("key"))
    return flat(traces.walked(starts, V.trace_nodes(spark, d), V.trace_edges(spark, d), 5, 4, targets=targets, direction="outgoing"))


@query("gr_20_spread")
def gr_20(spark, d):
    q = V.trace_queries(spark, d)
    return flat(traces.spread(q, V.trace_nodes(spark, d), V.trace_edges(spark, d), q, 4, 10))


@query("dq_03_trace")
def dq_03(spark, d):
    q = V.trace_queries(spark, d)
    return flat(traces.trace(q, V.trace_nodes(spark, d), V.trace_edges(spark, d), q, 3, 6))


#: What a node is worth to a query, apart from paths.
WORTH_SQL = f"""WITH RECURSIVE {V.TRACE_SQL},
terms AS (
  SELECT query, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda x: strlen(x) >= 3)) AS terms, contains(lower(text), 'test') AS asks_tests FROM trace_queries),
held AS (
  SELECT *, CASE WHEN qualified_name <> '' THEN qualified_name WHEN name <> '' THEN name ELSE path END AS label, {TEST_PATH} AS test,
    CASE WHEN path[1:9] = '@builtin/' THEN -140 WHEN path[1:10] = '@external/' THEN -50 ELSE 0 END AS place FROM trace_nodes)
"""


@query("rk_26_neighbours", WORTH_SQL + f""", b AS (
  SELECT query, key, dst AS next, relation FROM trace_queries JOIN trace_edges ON src = key WHERE dst IN (SELECT key FROM held)
  UNION ALL SELECT query, key, src, relation FROM trace_queries JOIN trace_edges ON dst = key WHERE src IN (SELECT key FROM held)),
v AS (SELECT b.*, h.label, h.place, h.test, t.terms, replace(b.relation, 'possible-', '') AS r, lower(h.name || ' ' || h.qualified_name || ' ' || h.path || ' ' || h.kind) AS v FROM b JOIN held h ON h.key = next JOIN terms t USING (query)),
s AS (SELECT query, key, next, relation, label, ((CASE {RELATION_CASES} ELSE 45 END) + 18 * len(list_filter(terms, lambda x: contains(v, x))) + {WORDS(discovery.CHANGES, 10)} + {WORDS(discovery.BEHAVIOURS, 4)} + place + CASE WHEN test THEN -120 ELSE 0 END)::BIGINT AS score FROM v)
SELECT query, key, next, relation, score, row_number() OVER (PARTITION BY query, key ORDER BY score DESC, relation, label, next) AS rank FROM s""")
def rk_26(spark, d):
    nodes, q = V.trace_nodes(spark, d), V.trace_queries(spark, d)
    beside = traces.adjacency(nodes, V.trace_edges(spark, d)).join(q.select("query", "key"), "key").select("query", "key", "next", "relation")
    return traces.ranked_neighbours(beside, nodes, q).withColumn("score", F.col("score").cast("long"))


IMPACT_SQL = ", ".join(f"'{r}'" for r in graph.IMPACT)


@query("dq_04_impact", WORTH_SQL + f""", e AS (SELECT DISTINCT src, dst, relation FROM trace_edges WHERE relation IN ({IMPACT_SQL})),
back(query, key, depth) AS (SELECT query, key, 0 FROM trace_queries UNION SELECT query, src, depth + 1 FROM back JOIN e ON dst = key WHERE depth < 4),
found AS (SELECT query, key, min(depth) AS depth FROM back GROUP BY ALL),
near AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM found WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY depth, key) <= 20),
rel AS (SELECT DISTINCT near.query, near.key, near.depth, relation, n FROM near JOIN e ON src = near.key JOIN found f ON f.query = near.query AND f.key = dst AND f.depth = near.depth - 1),
v AS (
  SELECT rel.*, h.*  EXCLUDE (key), t.terms, t.asks_tests, replace(relation, 'possible-', '') AS r, lower(name || ' ' || qualified_name || ' ' || path || ' ' || kind || ' ' || relation) AS v,
    lower(CASE WHEN qualified_name <> '' THEN qualified_name ELSE name END) AS called FROM rel JOIN held h USING (key) JOIN terms t USING (query)),
s AS (
  SELECT *, round((180 - (depth - 1) * 28 + 0.7 * (CASE {RELATION_CASES} ELSE 45 END) + 18 * len(list_filter(terms, lambda x: contains(v, x))) + {WORDS(discovery.CHANGES, 10)} + {WORDS(discovery.BEHAVIOURS, 4)} + place
    + CASE WHEN test AND NOT asks_tests THEN -120 ELSE 12 END + CASE WHEN relation LIKE 'possible-%' THEN -24 ELSE 12 END)::DOUBLE, 6) AS score FROM v),
once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, lower(path), called, kind, r ORDER BY score DESC, lower(path), called, relation, key) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, depth, lower(path), called, relation, key) AS rank, key, depth::INT AS depth, relation, score, count(*) OVER (PARTITION BY query) > 5 OR n > 20 AS truncated FROM once QUALIFY rank <= 5""")
def dq_04(spark, d):
    q = V.trace_queries(spark, d)
    return traces.impacted(q.select("query", "key"), V.trace_nodes(spark, d), V.trace_edges(spark, d), q, 4, 5)
