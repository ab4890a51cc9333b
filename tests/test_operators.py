"""Small fixtures with literal results."""

import random

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import graph, retrieval, temporal, vectors
from cairnwork.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens_part_at_boundaries(spark):
    got = one(spark, T.tokens(F.col("t")), t="parseHTTPRequest2 x_y été9")
    assert got == ["parsehttprequest2", "parse", "http", "request", "2", "x", "y", "été9", "été", "9"]


def test_lines_and_kinds(spark):
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\n\n") == ["a", "b", ""]
    assert one(spark, T.lines(F.col("t")), t=" \n ") == []
    assert [one(spark, T.document_kind(F.col("p")), p=p) for p in ("a/x.yml", "docs/adr/1.md", "planning/x.md", "a.rst", "b.md")] == ["config", "adr", "planning", "text", "markdown"]


@pytest.fixture
def diamond(spark):
    rows = [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", "calls"), ("c", "d", "possible-calls"), ("d", "a", "references"), ("x", "y", "calls")]
    return spark.createDataFrame(rows, "src string, dst string, relation string")


def test_reach_impact_and_paths(spark, diamond):
    start = spark.createDataFrame([("a",)], "key string")
    got = {r.key: r.depth for r in graph.distances(diamond, start, 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    end = spark.createDataFrame([("d",)], "key string")
    assert {r.key: r.depth for r in graph.impact(diamond, end, 2).collect()} == {"b": 1, "c": 1, "a": 2}
    assert {r.path for r in graph.simple_paths(diamond, start, 3).collect()} == {"a>calls>b", "a>calls>c", "a>calls>b>calls>d", "a>calls>c>possible-calls>d"}


def test_components_degrees_and_overlay(spark, diamond):
    assert {r.key: r.component for r in graph.components(diamond).collect()} == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x"}
    loop = spark.createDataFrame([("a", "a", "calls")], "src string, dst string, relation string")
    assert graph.degrees(loop).first()["degree"] == 2
    after = graph.overlay(diamond, diamond.filter("src = 'x'"), loop)
    assert {(r.src, r.change) for r in graph.difference(diamond, after).collect()} == {("x", "removed"), ("a", "added")}


def test_chain_of_components_is_followed(spark):
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", "calls") for i in range(120)], "src string, dst string, relation string")
    assert {r.component for r in graph.components(chain).collect()} == {"000"}


def test_components_of_many_rounds_are_whole(spark, monkeypatch):
    """Links of more than one task: contracted in rounds; an end that is null links nothing, but its other end is a node."""
    monkeypatch.setattr(graph, "LINKS", 16)
    rng = random.Random(7)
    pairs = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(300)] + [(f"b{rng.randrange(400)}", f"b{rng.randrange(400)}") for _ in range(350)] + [("hub", f"c{i}") for i in range(300)]
    parent = {k: k for p in pairs for k in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    rows = [*pairs, ("only", None), (None, None), *pairs[:50]]
    rng.shuffle(rows)
    got = graph.components(spark.createDataFrame(rows, "src string, dst string").repartition(20)).collect()
    assert len(got) == len(parent) + 1
    assert {r.key: r.component for r in got} == {**{k: find(k) for k in parent}, "only": "only"}


def test_shared_neighbours_are_counted_as_numbers(spark):
    """Names are ordered as texts, a target's null source shares nothing, and pairs are shuffled without their names."""
    rows = [(s, t, "calls") for s in ("s:10", "s:9", "s:2") for t in ("x", "y", "z")] + [("s:9", "w", "calls"), ("s:10", "w", "reads"), (None, "x", "calls"), (None, "y", "calls"), ("s:3", None, "calls")]
    found = graph.shared_neighbours(spark.createDataFrame(rows + rows, "src string, dst string, relation string"), 3)
    assert sorted(map(tuple, found.collect())) == [("s:10", "s:2", 3), ("s:10", "s:9", 4), ("s:2", "s:9", 3)]
    assert "keys=[x#" in found._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0, 9.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0]), (4, [float("nan"), 1.0])], "id int, v array<double>")
    got = {r.id: r.u for r in df.select("id", vectors.unit(F.col("v"), 2).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: None, 3: None, 4: None}


def test_overlap_is_reported_once(spark):
    a = spark.createDataFrame([(1, 1, 0, 40)], "key int, span_id int, start long, end long")
    b = spark.createDataFrame([(1, 7, 5, 30), (1, 8, 40, 50)], "key int, window_id int, start long, end long")
    assert [tuple(r) for r in temporal.overlapping(a, b, 8).collect()] == [(1, 7)]


def test_facts_last_line_wins(spark, tmp_path):
    from cairnwork.operators import facts

    line = lambda i, name: f'{{"record":"node","id":"{i}","kind":"function","name":"{name}","path":"a.go","qualified_name":"p.f"}}\n'
    (tmp_path / "a.jsonl").write_text(line(1, "z") + line(1, "a") + line(2, "old") + '{"record":"edge","source":"1","target":"9","relation":"calls"}\n{"record":"edge","source":"1","target":"","relation":"calls"}\n')
    (tmp_path / "b.jsonl").write_text(line(2, "new") + line("", "no"))
    nodes, edges, unresolved = facts.read_facts(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")])
    assert {r.id: r.name for r in nodes.collect()} == {"1": "a", "2": "new"} and edges.count() == 1 and unresolved.count() == 0
    (tmp_path / "bad.jsonl").write_text("{no json\n")
    with pytest.raises(Exception):
        facts.read_facts(spark, [str(tmp_path / "bad.jsonl")])[0].collect()


def test_fact_problems(spark, tmp_path):
    from cairnwork.operators import facts

    i = lambda c: "sha256:" + c * 64
    rows = [
        '{"record":"facts","schema_version":2,"adapter_version":"1","language":"go","repository":"r"}', f'{{"record":"node","id":"{i("b")}","kind":"function","name":"f","path":"a/../b.go","qualified_name":"q"}}',
        f'{{"record":"node","id":"{i("a")}","kind":"function","name":"f","path":"a.go","qualified_name":"q","span":{{"path":"a.go","start_line":3,"start_column":1,"end_line":2,"end_column":1}}}}',
        f'{{"record":"edge","source":"{i("a")}","target":"{i("c")}","relation":"calls"}}', '{"record":"node","id":"x","kind":"function","name":"f","path":"a.go","qualified_name":"q"}',
    ]
    (tmp_path / "f.jsonl").write_text("\n".join(rows))
    got = sorted(r.problem for r in facts.problems(facts.parsed(spark, [str(tmp_path / "f.jsonl")])).collect())
    assert got == ["header", "node id", "node path", "order", "order", "span", "unknown end"]


def test_tree_and_snapshots(spark, tmp_path):
    tree = {"sub/a.txt": b"text", "b.bin": b"a\0b", "node_modules/x.js": b"x", ".git/config": b"c", "yarn.lock": b"l", "gen.go": b"// Code generated by x; DO NOT EDIT", "docs/d.md": b"d"}
    for name, data in tree.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(data)
    root = str(tmp_path / "tree")
    assert sorted(r.path for r in files.read_tree(spark, root).collect()) == ["docs/d.md", "sub/a.txt"]
    assert [r.text for r in files.read_tree(spark, root, excluded=["docs"], extensions=[".txt", ".md"]).collect()] == ["text"]
    assert sorted(r.path for r in files.read_tree(spark, root, generated=True).collect()) == ["docs/d.md", "gen.go", "node_modules/x.js", "sub/a.txt", "yarn.lock"]
    store = str(tmp_path / "store")
    assert files.pointer(spark, store) == 0
    for n in (1, 2):
        assert files.publish(spark.range(n), store) == n
        assert files.current(spark, store).count() == n
    with pytest.raises(files.Conflict):
        files.publish(spark.range(9), store, expected=1)
    assert files.current(spark, store).count() == 2 and files.current(spark, store, 1).count() == 1


def test_shards_and_exports(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.lit("a"))
    files.publish_shards(df, "id", str(tmp_path / "s"), 8)
    files.publish_shards(df.withColumn("v", F.lit("b")), "id", str(tmp_path / "s"), 8, dirty=[3])
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 100 and {r.shard for r in got.filter("v = 'b'").collect()} == {3}
    files.export_lines(spark.createDataFrame([("go", i) for i in (3, 1, 2)] + [("py", 1)], "language string, i int"), "language", ["i"], str(tmp_path / "e"))
    assert sorted((r.language, r.i) for r in spark.read.json(str(tmp_path / "e")).collect()) == [("go", 1), ("go", 2), ("go", 3), ("py", 1)]


def test_ledgers(spark):
    from cairnwork.streaming import streams

    known, response = (spark.createDataFrame([(k,) for k in keys], "k string") for keys in ("ab", "bcc"))
    assert sorted(tuple(r) for r in streams.delta(response, known, ["k"]).collect()) == [("b", False), ("c", True)]


def test_exact_signals_inside_words(spark):
    texts = {1: "call parseHTTPRequest now", 2: "a ->* b", 3: "some longword here, then", 4: "plain", 5: "été2\nx", 6: None}
    values = {1: "Request", 2: "->*", 3: "ngword here, the", 4: "TTPReq", 5: "té2\n", 6: "request", 7: "p/", 8: None, 9: "here", 10: ""}
    files = spark.createDataFrame([(i, f"p/{i}.txt", t) for i, t in texts.items()], "doc_id int, path string, text string")
    signals = spark.createDataFrame([(i, v, 100) for i, v in values.items()], "signal_id int, value string, weight int")
    got = sorted(tuple(r) for r in retrieval.containing(files, signals).collect())
    want = [(i, d, 101 if v in f"p/{d}.txt" else 100) for i, v in values.items() if v is not None for d, t in texts.items() if v in f"p/{d}.txt" or v in (t or "")]
    assert got == sorted(want)


def test_signals_through_an_index(spark, tmp_path):
    from cairnwork.operators import lexical_index

    texts = {1: "call parseHTTPRequest now", 2: "a ->* b", 3: "Some Longword here, then", 4: "plain", 5: "été2\nx", 6: None}
    values = {1: "Request", 2: "->*", 3: "ngword here, the", 5: "té2\n", 7: "p/", 8: None, 9: "call parseHTTPRequest n", 10: "", 11: "p/3.t", 12: "ome Longword h", 13: "ome longword h"}
    files = spark.createDataFrame([(i, f"p/{i}.txt", t) for i, t in texts.items()], "doc_id int, path string, text string")
    signals = spark.createDataFrame([(i, v, 100) for i, v in values.items()], "signal_id int, value string, weight int")
    lexical_index.build(files.select("doc_id", "text"), f"file://{tmp_path}/x")
    index = lexical_index.read(spark, f"file://{tmp_path}/x")
    want = sorted(tuple(r) for r in retrieval.containing(files, signals).collect())
    assert sorted(tuple(r) for r in retrieval.containing(files, signals, index).collect()) == want and len(want) > 10


def test_components_cover_every_end(spark, sf_dir):
    from cairnwork.plans import registry, views

    edges = views.edges(spark, sf_dir)
    ends = edges.select("src").union(edges.select("dst")).distinct().count()
    assert registry.QUERIES["gr_13_components"](spark, sf_dir).count() == ends


def test_synthetic_graphs(spark):
    for topology in ("chain", "entangled", "hub", "layered", "modular"):
        made = {tuple(r) for r in graph.synthetic(spark, topology, 2000, 20_000, 7).collect()}
        assert len(made) > 10_000 and all(a != b and 0 <= b < 2000 for a, b in made)
        removed, added = (df.count() for df in graph.mutated(graph.synthetic(spark, topology, 2000, 20_000, 7), 0.05, 2000, 3))
        assert 500 < removed and 400 < added <= removed
