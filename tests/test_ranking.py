"""Hybrid seeds and diversity against plain loops."""

import math

from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import ranking


def words(spark, text):
    return set(spark.range(1).select(T.hybrid_tokens(F.lit(text)).alias("x")).first()["x"])


def test_roots(spark):
    got = spark.range(1).select(F.transform(F.array(*map(F.lit, ("entries", "rendering", "called", "boxes", "classes", "paths", "glass", "callers", "resolved", "as", "limits"))), T.hybrid_root).alias("x")).first()["x"]
    assert got == ["entry", "render", "call", "boxe", "classe", "path", "glass", "call", "resolve", "as", "bound"]


def test_hybrid_base_against_plain_loops(spark):
    nodes = {"a": ("parseHTTPRequest", "net.parseHTTPRequest", "src/net/http.go"), "b": ("graph", "g.graph", "graph/node.go"), "c": ("loadEntries", "x.loadEntries", "store/load.go"), "d": ("", "", "x")}
    query = "how does parseHTTPRequest load graph entries from the store"
    symbols, vectors = {"a": 1, "c": 2, "d": 3}, {"a": (3, 0.2), "b": (1, 0.9)}
    got = {r.key: r.base for r in ranking.hybrid_base(
        spark.createDataFrame([(1, k, r) for k, r in symbols.items()], "query_id int, key string, rank int"),
        spark.createDataFrame([(1, k, *x) for k, x in vectors.items()], "query_id int, key string, rank int, score double"),
        spark.createDataFrame([(k, *x) for k, x in nodes.items()], "key string, name string, qualified_name string, path string"),
        spark.createDataFrame([(1, query)], "query_id int, text string"),
    ).collect()}
    asked = words(spark, query)
    weigh = lambda ws: sum(min(len(w), 10) / 10 for w in ws)
    text = lambda s: spark.range(1).select(T.hybrid_text(F.lit(s)).alias("x")).first()["x"]
    low, high, most = 0.2, 0.9, 3
    for k, (name, qualified, path) in nodes.items():
        own, hit = words(spark, name), words(spark, name) & asked
        if not own or not hit:
            identifier = 0.0
        elif len(own) == 1:
            one = next(iter(own))
            identifier = (0.35 + min(len(one), 10) / 40) * (0.45 if one in T.HYBRID_GENERIC else 1)
        else:
            identifier = weigh(hit) / weigh(own)
            identifier = min(1, identifier + 0.15) if len(hit) >= 2 else identifier
            identifier = max(identifier, 0.9) if len(text(name)) >= 6 and text(name) in text(query) else identifier
            identifier = max(identifier, 0.95) if len(text(qualified)) >= 6 and text(qualified) in text(query) else identifier
        of_path = words(spark, path)
        score = 0.20 * identifier + 0.08 * (weigh(of_path & asked) / weigh(of_path) if of_path else 0)
        if k in vectors:
            rank, s = vectors[k]
            score += 0.40 * (0.65 * (s - low) / (high - low) + 0.35 * (1 - (rank - 1) / (most - 1)))
        score += 0.16 / math.sqrt(symbols[k]) if k in symbols else 0
        score += 0.08 if k in symbols and k in vectors else 0
        assert abs(got[k] - score) < 1e-9, k


def test_two_hops_over_connectors(spark):
    nodes = spark.createDataFrame([("a", "function", "x"), ("e", "http-endpoint", "@net"), ("h", "function", "y"), ("z", "function", "@lib")], "key string, kind string, path string")
    edges = spark.createDataFrame([("a", "e", "calls-endpoint"), ("e", "h", "handled-by"), ("a", "z", "calls")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([(1, "a", 50.0)], "query_id int, key string, score double")
    got = {r.key: round(r.score, 6) for r in ranking.expanded(seeds, edges, nodes).collect()}
    assert got == {"e": 39.0, "h": round(39.0 * 0.62 + 8, 6)}


def test_symbol_scores_against_plain_loops(spark):
    """Names of any length, kinds of every sort, terms inside of names, whole names in texts; no pairs of all nodes and queries."""
    import random
    import re

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcñ1_") for _ in range(r.randrange(1, 5)))
    names = [r.choice(["", "", "x ", "data"]) + r.choice(["", "Ab", "a1"]) + word() for _ in range(60)] + ["data", "ñ", "a", "", None, "aΣb", "error"]
    nodes = [(f"k{i}", r.choice(["function", "field", "http-endpoint", "x"]), n, r.choice(["src/", "src/tests/", "a/legacy/", "@b/", ""]) + word(), r.choice(["", "q.", "M::"]) + word() + (n or "")) for i, n in enumerate(names)]
    texts = [" ".join([word() for _ in range(r.randrange(1, 6))] + [r.choice(names) or ""]) for _ in range(40)] + ["data", "ab", "", "  ", "ς", "error of data", None] + [n[4].upper() for n in nodes[:9]] + [n[3] for n in nodes[:9]]
    queries = list(enumerate(texts))
    df = spark.createDataFrame(nodes, "key string, kind string, name string, path string, qualified_name string")
    asked = spark.createDataFrame(queries, "query_id int, text string")
    terms = {x.query_id: x.t for x in asked.select("query_id", T.symbol_query_terms(F.col("text")).alias("t")).collect()}
    parts = {x.key: x.t for x in df.select("key", T.identifier_terms(F.col("name")).alias("t")).collect()}
    weight = lambda k: next((w for w, ks in ranking.KIND_WEIGHTS.items() if k in ks.split()), 0)
    want = {}
    for i, text in queries:
        for key, kind, shown, path, qualified in nodes:
            if text is None or not (kind == "http-endpoint" or (path and not path.startswith("@"))):
                continue
            q, name, qual, low = text.lower().strip(" "), None if shown is None else shown.lower(), qualified.lower(), path.lower()
            within = lambda t, x: x is not None and t in x
            hits = [9 if t in (parts[key] or []) else 6 if within(t, name) else 3 if within(t, qual) else 2 if within(t, low) else 0 for t in terms[i]]
            long = name is not None and len(name.encode()) >= 2
            exact, generic, little = long and q == name, shown is not None and shown.strip(" ") in ranking.GENERIC_NAMES, kind in ranking.LOW_SIGNAL
            named = long and name in q and (exact or len(hits) <= 3 or len(parts[key]) >= 2) and (not generic or exact) and (not little or exact)
            raw = 32 * named + 48 * (q == qual != "") + 48 * (q == low != "") + sum(hits)
            n = sum(h > 0 for h in hits)
            score = raw + (n > 1) * (n - 1) * 4 + (n / len(hits) * 18 if len(hits) > 1 else 0) - 24 * (generic and not exact and len(hits) >= 4 and sum(h in (2, 3) for h in hits) < 2) + weight(kind)
            score -= 8 * bool(re.search("/test|_test[.]|/spec", low)) + 10 * ("/legacy/" in low)
            if raw > 0 and score >= 9 and (not little or exact or n >= 2):
                want[i, key] = score
    found = ranking.symbol_scores(df, asked)
    got = {(x.query_id, x.key): x.score for x in found.collect()}
    assert len(got) > 100 and found.count() == len(got)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
