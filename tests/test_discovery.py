"""Composite search, sync decisions and grounding on small fixtures."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import discovery, vectors

CHUNKS = [
    ("c1", "src/load.go", "func loadEntries reads entries\nfrom the store"), ("c2", "src/load.go", "loadEntries is called here"), ("c3", "src/load.go", "more entries of the store"),
    ("c4", "src/store.go", "store keeps entries\nentries"), ("c5", "docs/readme.md", "loadEntries documented entries store"), ("c6", "x/other.go", "nothing to see"),
]
NODES = [("n1", "function", "loadEntries", "src/load.go", "store.loadEntries"), ("n2", "type", "Store", "src/store.go", "store.Store"), ("n3", "function", "other", "x/other.go", "x.other"), ("n4", "function", "loadEntries", "docs/x.md", "d.loadEntries")]
QUERIES = [(1, "loadEntries of the store"), (2, "nothing")]


@pytest.fixture(scope="module")
def made(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, path string, text string")
    nodes = spark.createDataFrame(NODES, "key string, kind string, name string, path string, qualified_name string")
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    return chunks, nodes, queries


def test_chunk_scores_against_plain_loops(spark, made):
    chunks, _, queries = made
    none = spark.createDataFrame([], "query_id int, chunk_id string, score double")
    got = {(r.query_id, r.chunk_id): r.score for r in discovery.chunk_scores(chunks, none, queries).collect()}
    tokens = lambda s: set(spark.range(1).select(T.tokens(F.lit(s)).alias("x")).first()["x"])
    terms = {1: ["loadentries", "load", "entries", "store"], 2: ["nothing"]}
    want = {}
    for q, ts in terms.items():
        for c, path, text in CHUNKS:
            base, whole, lead = tokens(path.split("/")[-1]), tokens(path), tokens(text.split("\n")[0])
            score = sum((8 if t in base else 4 if t in whole else 0) + (4 if t in lead else 0) for t in ts)
            if any(t in whole | lead for t in ts):
                want[q, c] = score + (12 if len(ts) > 1 and "loadentries of the store" in text.lower() else 0)
    assert got == want


def test_lanes(spark, made):
    results, coverage = discovery.search(*made, limit=2)
    rows = results.collect()
    lane = lambda q, name: [r.key for r in sorted((r for r in rows if r.query_id == q and r.lane == name), key=lambda r: r["rank"])]
    assert not set(lane(1, "exact")) & set(lane(1, "source"))
    assert set(lane(1, "exact")) == {"c1", "c2"} and "c5" not in {r.key for r in rows} and lane(1, "symbol")[0] == "n1" and "n4" not in lane(1, "symbol")
    assert lane(2, "exact") == [] and lane(2, "source") == ["c6"]
    for c in coverage.collect():
        assert c.returned == len(lane(c.query_id, c.lane)) and c.deferred == c.available - c.returned >= 0 and c.previewed <= 2
    assert {(c.query_id, c.lane) for c in coverage.collect()} == {(q, x) for q in (1, 2) for x in ("exact", "source", "symbol")}


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "at a/b.go:3 and a/b.go:2-9, a/b.go:0 x.md:1")], "answer_id int, text string")
    lines = spark.createDataFrame([("a/b.go", 8)], "path string, n_lines int")
    assert {r.citation: r.grounded for r in discovery.grounded(answers, lines).collect()} == {"a/b.go:3": True, "a/b.go:2-9": False, "a/b.go:0": False, "x.md:1": False}


def test_vectors_of_other_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    assert df.select(vectors.dot(F.col("a"), F.col("b")).alias("x")).first()["x"] == 0 and math.isclose(df.select(vectors.dot(F.col("a"), F.col("a")).alias("x")).first()["x"], 5)


def test_nearest_by_blocks_of_any_size(spark):
    import random

    r = random.Random(2)
    vs = [(i, [r.randint(-3, 3) / 2 for _ in range(r.choice([3, 3, 4]))]) for i in range(40)] + [(40, None), (41, [])]
    qs = [(i, v) for i, v in vs if i % 3 == 0 or i > 39]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a is not None and b is not None and len(a) == len(b) else 0.0
    want = {(q, *x) for q, a in qs for x in [(v, round(s, 6), n + 1) for n, (v, s) in enumerate(sorted(((v, dot(a, b)) for v, b in vs), key=lambda x: (-x[1], x[0]))[:5])]}
    v, q = spark.createDataFrame(vs, "vec_id long, v array<double>"), spark.createDataFrame(qs, "query_id long, q array<float>")
    for block in (1, 7, 1024):
        assert {tuple(x) for x in vectors.nearest(v, q, 5, block).select("query_id", "vec_id", "score", "rank").collect()} == want
    assert vectors.nearest(v.limit(0), q, 5).count() == 0
    parts = q.select((F.col("query_id") % 2).alias("query_id"), F.col("query_id").alias("part"), "q")
    best = {}
    for i, a in qs:
        for j, b in vs:
            best[i % 2, j] = max(best.get((i % 2, j), -1e9), dot(a, b))
    pooled = {(g, *x) for g in (0, 1) for x in [(j, round(s, 6), n + 1) for n, (j, s) in enumerate(sorted(((j, s) for (h, j), s in best.items() if h == g), key=lambda x: (-x[1], x[0]))[:4])]}
    assert {tuple(x) for x in vectors.nearest_to_parts(v, parts, 4).select("query_id", "vec_id", "score", "rank").collect()} == pooled


def test_windows_of_queries(spark):
    q = spark.createDataFrame([(1, list("abcdefg")), (2, list("abc")), (3, [])], "query_id int, tokens array<string>")
    told = lambda **o: sorted((r.query_id, r.part, r.label, "".join(r.tokens)) for r in vectors.windows(q, 3, **o).collect())
    split = [(1, i, f"split window {i + 1}/3", t) for i, t in enumerate(("abc", "def", "g"))]
    assert told() == [*split, (2, 0, "split window 1/1", "abc")]
    assert told(mode="full", most=5) == [(1, 0, "full query", "abcde"), (2, 0, "full query", "abc")]
    assert told(mode="quality") == [(1, 0, "full query", "abcdefg"), *((q, i + 1, w, t) for q, i, w, t in split), (2, 0, "full query", "abc")]


def test_ranges_of_just_a_node_meet_no_others(spark):
    """Ranges that a node has just so are matched by their ends, not against all nodes of the path; the others by what they touch."""
    from cairnwork.operators import discovery

    nodes = spark.createDataFrame([("k1", "type", "a", 1, 5), ("k2", "field", "a", 2, 3), ("k3", "module", "a", 4, 9), ("k4", "type", "b", 1, 5)], "key string, kind string, path string, start_line int, end_line int")
    ranges = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 3, 4), (3, "b", 6, 7), (4, "a", 1, 5)], "range_id long, path string, a int, b int")
    met = discovery.declarations(ranges, nodes)
    assert sorted(map(tuple, met.collect())) == [(1, "k2", 1), (2, "k1", 1), (2, "k2", 3), (2, "k3", 2), (4, "k1", 1)]
    met = discovery.declarations(ranges.filter("range_id in (1, 4)"), nodes)
    assert re.search(r"[( ]a#\d+ = |[^<>]= a#\d+", met._jdf.queryExecution().optimizedPlan().toString())  # an end is part of a join's key


def test_neighbourhoods_place_each_way_apart(spark):
    """Repeated edges count once, and no edge is dealt by its key and way after it was made distinct."""
    nodes = spark.createDataFrame([(k, "function", k, f"f/{k}", k) for k in "abcd"], "key string, kind string, name string, path string, qualified_name string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("a", "c", "calls"), ("d", "a", "reads")], "src string, dst string, relation string")
    found = discovery.neighbourhoods(nodes, edges, most=1)
    got = {r.key: r.text for r in found.collect()}
    assert got["a"] == "function a a\npath f/a\nout calls b; omitted 1\nin reads d" and got["c"] == "function c c\npath f/c\nin calls a"
    assert "way#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_snapshots_with_nulls_are_the_same(spark):
    nodes = spark.createDataFrame([("a",), (None,)], "key string")
    edges = spark.createDataFrame([("a", None, "calls"), ("a", "a", "calls")], "src string, dst string, relation string")
    assert discovery.sync_decision(True, nodes, nodes, edges, edges) == "existing"
    assert discovery.sync_decision(True, nodes, nodes, edges, edges.filter("dst IS NULL")) == "overlay"
    assert discovery.sync_decision(True, nodes.filter("key = 'a'"), nodes, edges, edges) == "rebuild"
