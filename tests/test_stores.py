"""The graph store and its compaction, consumers of snapshots, and bitset searches, against sets and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import graph, seeds
from cairnwork.sources import files, graph_store
from cairnwork.streaming import consumers

EDGES = "src string, dst string, relation string"


def test_versions_equal_sets_and_only_dirty_shards_are_written(spark, tmp_path):
    r, root = random.Random(1), f"file://{tmp_path}/g"
    edge = lambda: (f"k{r.randint(0, 30)}", f"k{r.randint(0, 30)}", r.choice(["calls", "contains"]))
    want = {edge() for _ in range(150)}
    graph_store.create(spark.createDataFrame([*want, *list(want)[:9]], EDGES), root, shards=8)
    for _ in range(2):
        changes = {edge(): r.random() < 0.5 for _ in range(3)}
        changes |= dict.fromkeys(r.sample(sorted(want), 2), False)
        graph_store.append(spark.createDataFrame([(*e, a) for e, a in changes.items()], EDGES + ", added boolean"), root, shards=8)
        want = (want | {e for e, a in changes.items() if a}) - {e for e, a in changes.items() if not a}
        assert {tuple(x) for x in graph_store.edges(spark, root).collect()} == want
    before = {(x["shard"], x["folder"]) for x in files.current(spark, root).filter("number = 0").collect()}
    dirty = {x["shard"] for x in files.current(spark, root).filter("number > 0").collect()}
    assert dirty and len(dirty) < 8
    number = graph_store.compact(spark, root)
    after = files.current(spark, root).collect()
    assert {tuple(x) for x in graph_store.edges(spark, root).collect()} == want and {x["number"] for x in after} == {0}
    assert {(x["shard"], x["folder"]) for x in after if x["shard"] not in dirty} == {x for x in before if x[0] not in dirty}
    assert graph_store.compact(spark, root) == number  # nothing is left to merge
    assert {tuple(x) for x in graph_store.edges(spark, root, number - 1).collect()} == want  # an earlier version stays readable


def test_shards_without_deltas_are_read_without_merging(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    rows = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls")], EDGES)
    graph_store.create(rows, root, shards=2)
    read = graph_store.edges(spark, root)
    assert sorted(map(tuple, read.collect())) == [("a", "b", "calls"), ("b", "c", "calls")]
    assert "max_by" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_a_compaction_that_loses_edges_is_not_published(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/g"
    graph_store.create(spark.createDataFrame([("a", "b", "calls"), ("a", "c", "calls")], EDGES), root, shards=1)
    at = graph_store.append(spark.createDataFrame([("a", "d", "calls", True)], EDGES + ", added boolean"), root, shards=1)
    whole = graph_store._write
    monkeypatch.setattr(graph_store, "_write", lambda rows, folder: whole(rows.filter("dst <> 'b'"), folder))
    with pytest.raises(graph_store.Mismatch):
        graph_store.compact(spark, root)
    assert files.pointer(spark, root) == at and graph_store.edges(spark, root).count() == 3


def test_consumers_get_each_version_once_and_failures_are_handed_out_again(spark, tmp_path):
    root, state, seen, broken = f"file://{tmp_path}/v", f"file://{tmp_path}/state", [], [True]

    def steady(df, number):
        seen.append(("steady", number, df.count()))

    def shaky(df, number):
        if broken[0] and number == 2:
            raise ValueError("not now")
        seen.append(("shaky", number, df.count()))

    both, checkpoint = {"steady": steady, "shaky": shaky}, f"file://{tmp_path}/cp"
    files.publish(spark.range(3).toDF("n"), root, 0)
    consumers.watch(spark, root, state, both, checkpoint)
    assert seen == [("shaky", 1, 3), ("steady", 1, 3)]
    files.publish(spark.range(5).toDF("n"), root, 1)
    with pytest.raises(Exception, match="not now"):
        consumers.watch(spark, root, state, both, checkpoint)
    assert seen[2:] == [("steady", 2, 5)]
    broken[0] = False
    consumers.watch(spark, root, state, both, checkpoint)  # the batch is replayed
    assert seen[3:] == [("shaky", 2, 5)]
    consumers.hand_out(spark, root, state, both, [1, 2])
    assert len(seen) == 4 and consumers.finished(spark, state, "steady") == {1, 2}


def plain_search(edges, start, depth, reverse=False):
    near = {}
    for a, b, _ in edges:
        near.setdefault(b if reverse else a, set()).add(a if reverse else b)
    found, front = {start: 0}, {start}
    for level in range(1, depth + 1):
        front = {y for x in front for y in near.get(x, ())} - set(found)
        found |= dict.fromkeys(front, level)
    return found


def test_many_seeds_over_several_words(spark):
    r = random.Random(4)
    edges = {(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}", "calls") for _ in range(260)} | {("hub", f"n{i}", "calls") for i in range(150)} | {(f"n{i}", "hub", "calls") for i in range(0, 150, 9)}
    own = [f"n{i}" for i in range(140)] + ["hub", "alone"]  # 142 seeds: three words
    e, s = spark.createDataFrame(sorted(edges), EDGES), spark.createDataFrame([(k,) for k in own], "key string")
    places = seeds.numbered(s)
    assert places.select("word").distinct().count() == 3
    rows = seeds.told(seeds.reached(e.select(F.col("src").alias("key"), F.col("dst").alias("next")), places, 3), places).collect()
    got = {}
    for x in rows:
        got.setdefault(x["seed"], {})[x["key"]] = x["depth"]
    assert len(rows) == sum(map(len, got.values()))  # each once
    assert got == {k: plain_search(edges, k, 3) for k in own}


def test_chains_and_dependents_of_seeds(spark):
    edges = [("a", "b", "calls"), ("a", "c", "possible-calls"), ("b", "d", "calls"), ("b", "d", "possible-calls"), ("c", "d", "calls"), ("d", "a", "calls"), ("d", "e", "contains"), ("x", "a", "references"), ("e", "e", "calls")]
    e = spark.createDataFrame(edges, EDGES)
    pairs = spark.createDataFrame([("a", "d"), ("d", "b"), ("a", "e"), ("b", "c"), ("a", "a"), ("a", "d")], "start string, target string")
    got = {(r["start"], r["target"]): (list(r["nodes"]), list(r["relations"])) for r in seeds.chains(e, pairs).collect()}
    assert got == {("a", "d"): (["a", "b", "d"], ["calls", "calls"]), ("d", "b"): (["d", "a", "b"], ["calls", "calls"]), ("b", "c"): (["b", "d", "a", "c"], ["calls", "calls", "possible-calls"])}
    assert seeds.chains(e, pairs, depth=2).count() == 2
    rows = seeds.dependents(e, spark.createDataFrame([("a",), ("e",)], "key string"), limit=2).collect()
    assert {(r["seed"], r["nth"], r["key"], r["depth"], r["truncated"]) for r in rows} == {("a", 1, "d", 1, True), ("a", 2, "x", 1, True)}  # contains is no dependence
    assert graph.IMPACT


def test_a_fact_stream_is_written_by_several_tasks(spark, sf_dir):
    """Files that are each in order, none by one task that sorts all; read back they are sound."""
    import os

    from cairnwork.operators import facts
    from cairnwork.plans import fact_queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join such small files
    try:
        paths = fact_queries.stream_of_parts(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len([n for n in os.listdir(paths[0].removeprefix("file://")) if n.startswith("part-")]) > 1
    assert facts.problems(facts.parsed(spark, paths)).count() == 0


def test_chains_are_searched_from_both_ends(spark, monkeypatch):
    """Random graphs, with pairs in one another's way, against a search for each; neither end is searched over half the depth."""
    import random

    from cairnwork.operators import seeds

    depths, whole = [], seeds.reached
    monkeypatch.setattr(seeds, "reached", lambda steps, places, depth: depths.append(depth) or whole(steps, places, depth))
    r = random.Random(7)
    edges = sorted({(f"k{r.randrange(150):03}", f"k{r.randrange(150):03}", r.choice(["calls", "possible-calls", "reads"])) for _ in range(330)})
    pairs = sorted({(f"k{r.randrange(150):03}", f"k{r.randrange(150):03}") for _ in range(400)})
    steps = {}
    for a, b, rel in edges:
        if rel != "reads":
            steps.setdefault(a, {})[b] = min(rel, steps.get(a, {}).get(b, rel))

    def first(start, target, depth):
        at = {start: ((start,), ())}
        seen = {start}
        for _ in range(depth):
            new = {}
            for k in at:
                for n, rel in steps.get(k, {}).items():
                    if n not in seen:
                        path = (at[k][0] + (n,), at[k][1] + (rel,))
                        new[n] = min(path, new.get(n, path))
            seen |= set(new)
            if target in new:
                return new[target]
            at = new
        return None

    e, p = spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame(pairs, "start string, target string")
    for depth in (8, 5, 1):
        want = {(a, b): first(a, b, depth) for a, b in pairs if a != b}
        got = {(x["start"], x["target"]): (tuple(x["nodes"]), tuple(x["relations"])) for x in seeds.chains(e, p, depth).collect()}
        assert got == {k: v for k, v in want.items() if v}
    assert max(depths) == 4
