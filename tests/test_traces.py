"""Walks, their scores and the choice among them against a queue walker on small graphs."""

import random

import pytest

from cairnwork.operators import traces

CONTEXT = ("contains", "defines", "imports")
RELATIONS = ["calls", "possible-calls", "contains", "defines", "imports", "reads", "calls-endpoint", "references", "Possible-Imports"]


def graph_of(seed, n=26, edges=70):
    r = random.Random(seed)
    places = ["src/a.go", "src/test/b.go", "@builtin/c", "@external/d", "svc/logging/e.go", "x/handle.go"]
    nodes = {f"k{i:02}": dict(kind=r.choice(["function", "variable", "type"]), name=r.choice(["", "apply", "sendOne", "read"]), path=r.choice(places),
                              qualified_name=r.choice(["", f"app.q{i}", "app.same"])) for i in range(n)}
    keys = [*nodes, "gone"]  # one end is no node
    return nodes, sorted({(r.choice(keys[: 6 if r.random() < 0.3 else n + 1]), r.choice(keys), r.choice(RELATIONS)) for _ in range(edges)})


def context(relation):
    return relation.lower().strip().removeprefix("possible-") in CONTEXT


def beside(nodes, edges, direction):
    found = {}
    for a, b, rel in edges:
        first = 0 if rel in traces.BETWEEN_STACKS else 1 if rel in traces.CALLS else 2
        if direction != "incoming" and b in nodes:
            found.setdefault(a, []).append((first, b, "outgoing", rel))
        if direction != "outgoing" and a in nodes:
            found.setdefault(b, []).append((first, a, "incoming", rel))
    return {k: sorted(v) for k, v in found.items()}


def walker(nodes, edges, starts, targets, depth, limit, direction):
    near = beside(nodes, edges, direction)
    most, waiting = (64, 4096) if targets else (min(max(limit, 8), 16), min(max(limit * 8, 64), 512))
    seen, queue, out = set(), [], []
    for s in starts:
        if s in nodes and s not in seen:
            seen.add(s)
            queue.append(([s], [], []))
    while queue and len(out) < limit:
        at, rels, dirs = queue.pop(0)
        if len(rels) >= depth:
            continue
        own = 0
        for _, nxt, d, rel in near.get(at[-1], []):
            if nxt in seen:
                continue
            path = (at + [nxt], rels + [rel], dirs + [d])
            hit = nxt in targets
            if hit or not targets and any(not context(x) for x in path[1]):
                out.append(path)
                if len(out) >= limit:
                    break
            if hit or len(path[1]) >= depth:
                continue
            seen.add(nxt)
            if len(queue) < waiting:
                queue.append(path)
            own += 1
            if own >= most:
                break
    return out


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(k, v["kind"], v["name"], v["path"], v["qualified_name"]) for k, v in nodes.items()], "key string, kind string, name string, path string, qualified_name string")
    return n, spark.createDataFrame([*edges, *edges[:5]], "src string, dst string, relation string")


def starts_of(spark, starts):
    return spark.createDataFrame([(q, k, i) for q, ks in starts.items() for i, k in enumerate(ks)], "query int, key string, place int")


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query"], {})[r["nth"]] = (list(r["nodes"]), list(r["relations"]), list(r["directions"]))
    return {q: [v[i] for i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize(("seed", "depth", "limit", "direction"), [(1, 3, 5, "both"), (2, 2, 40, "outgoing"), (3, 4, 12, "incoming"), (4, 1, 3, "both")])
def test_walks_equal_a_queue(spark, seed, depth, limit, direction):
    nodes, edges = graph_of(seed)
    starts = {1: ["k00", "k01"], 2: ["k05"], 3: ["gone", "k07", "k07"], 4: ["k02"], 5: ["k20"]}
    n, e = frames(spark, nodes, edges)
    got = collected(traces.walked(starts_of(spark, starts), n, e, depth, limit, direction=direction))
    want = {q: walker(nodes, edges, ks, set(), depth, limit, direction) for q, ks in starts.items()}
    assert got == {q: v for q, v in want.items() if v}


def test_walks_to_targets_equal_a_queue(spark):
    nodes, edges = graph_of(7, n=30, edges=120)
    starts, targets = {1: ["k00"], 2: ["k03", "k04"], 3: ["k09"]}, {1: ["k10", "k11"], 2: ["k12"], 3: ["k09", "k01"]}
    n, e = frames(spark, nodes, edges)
    t = spark.createDataFrame([(q, k) for q, ks in targets.items() for k in ks], "query int, key string")
    got = collected(traces.walked(starts_of(spark, starts), n, e, 4, 6, targets=t))
    want = {q: walker(nodes, edges, ks, set(targets[q]), 4, 6, "both") for q, ks in starts.items()}
    assert got == {q: v for q, v in want.items() if v}


def test_a_hub_fills_the_branches_and_the_queue(spark):
    nodes = {f"h{i:04}": dict(kind="function", name=f"n{i}", path=f"src/{i}.go", qualified_name="") for i in range(700)}
    edges = [("h0000", f"h{i:04}", "contains") for i in range(1, 40)] + [(f"h{i:04}", f"h{40 + (i * 16 + j) % 660:04}", "defines") for i in range(1, 40) for j in range(16)]
    edges += [(f"h{i:04}", f"h{(i + 7) % 700:04}", "calls") for i in range(100, 300)]
    n, e = frames(spark, nodes, edges)
    for limit in (3, 100):
        got = collected(traces.walked(starts_of(spark, {1: ["h0000"], 2: ["h0001", "h0002"]}), n, e, 4, limit, direction="outgoing"))
        want = {q: walker(nodes, edges, ks, set(), 4, limit, "outgoing") for q, ks in {1: ["h0000"], 2: ["h0001", "h0002"]}.items()}
        assert got == {q: v for q, v in want.items() if v}


# -- scores, by plain loops

def label(n):
    return n["qualified_name"] or n["name"] or n["path"] or n["kind"]


def is_test(path):
    return any(x in path.lower() for x in ("/test/", "/tests/", "_test.", "_tests.", "/spec/", "_spec."))


def place(path):
    return -140 if path.startswith(("@builtin/", "@stdlib/")) else -50 if path.startswith("@external/") else 0


def worth(n, terms):
    from cairnwork.operators.discovery import BEHAVIOURS, CHANGES

    v = " ".join((n["name"], n["qualified_name"], n["path"], n["kind"])).lower()
    fixed = sum(10 for w in CHANGES if w in v) + sum(4 for w in BEHAVIOURS if w in v)
    return sum(18 for t in terms if t in v) + fixed + place(n["path"]) - 120 * is_test(n["path"])


def relation_worth(relation):
    from cairnwork.operators.discovery import RELATION_SCORES

    return next((s for s, names in RELATION_SCORES.items() if relation.lower().removeprefix("possible-") in names.split()), 45)


def spreader(nodes, edges, starts, text, depth, limit, direction):
    terms = list(dict.fromkeys(w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split() if len(w.encode()) >= 3))
    near, most = beside(nodes, edges, direction), min(2 * limit, 32)
    seen, queue, counts, doing, idle = set(), [], {}, [], []
    for s in starts:
        if s in nodes and s not in seen:
            seen.add(s)
            queue.append(([s], [], [], label(nodes[s])))
    for level in range(depth):
        front, queue = queue[:8], []
        if not front or len(doing) >= most:
            break
        for at, rels, dirs, entry in front:
            ranked = sorted(near.get(at[-1], []), key=lambda x: (-(relation_worth(x[3]) + worth(nodes[x[1]], terms)), x[3], label(nodes[x[1]]), x[1], x[2]))
            own = 0
            for _, nxt, d, rel in ranked:
                if nxt in seen:
                    continue
                e = label(nodes[nxt]) if level == 0 and context(rel) else entry
                path = (at + [nxt], rels + [rel], dirs + [d])
                if any(not context(x) for x in path[1]):
                    if counts.get(e.lower(), 0) < 4:
                        doing.append(path)
                        counts[e.lower()] = counts.get(e.lower(), 0) + 1
                elif len(idle) < most:
                    idle.append(path)
                if level + 1 >= depth:
                    continue
                seen.add(nxt)
                queue.append((*path, e))
                own += 1
                if len(doing) >= most or own >= 2 or len(queue) >= 8:
                    break
            if level + 1 < depth and (len(doing) >= most or len(queue) >= 8):
                break
    return (doing or idle)[:limit]


@pytest.mark.parametrize(("seed", "depth", "limit"), [(11, 3, 10), (12, 2, 3), (13, 5, 16)])
def test_spreading_equals_plain_loops(spark, seed, depth, limit):
    nodes, edges = graph_of(seed, edges=110)
    starts = {1: ["k00", "k01"], 2: ["k05"], 3: ["k02", "k03", "k04"], 4: ["k20"]}
    n, e = frames(spark, nodes, edges)
    q = spark.createDataFrame([(i, "How is app q3 sent to apply") for i in starts], "query int, text string")
    got = collected(traces.spread(starts_of(spark, starts), n, e, q, depth, limit))
    want = {i: spreader(nodes, edges, ks, "How is app q3 sent to apply", depth, limit, "both") for i, ks in starts.items()}
    assert got == {i: v for i, v in want.items() if v}


def test_choice_keeps_two_of_an_entry_and_few_tests(spark):
    nodes = {
        "a": dict(kind="function", name="", path="src/a.go", qualified_name="app.A"), "t": dict(kind="function", name="T", path="src/test/t.go", qualified_name=""),
        "b": dict(kind="function", name="B", path="src/b.go", qualified_name="app.B"), "c": dict(kind="variable", name="C", path="src/c.go", qualified_name=""),
        "x": dict(kind="function", name="len", path="@builtin/len", qualified_name=""), "m": dict(kind="method", name="m", path="src/m.go", qualified_name="app.A.m"),
    }
    paths = [("a", "calls", "b"), ("a", "calls", "c"), ("a", "reads", "c"), ("a", "calls", "t"), ("a", "calls", "x"), ("a", "contains", "m"), ("a", "contains", "m", "possible-writes", "b"), ("A",)]
    rows = [(1, i, list(p[::2]), list(p[1::2])) for i, p in enumerate(paths) if len(p) > 1] + [(2, 0, ["a", "m"], ["contains"]), (3, 0, ["a", "t"], ["calls"]), (3, 1, ["a", "b"], ["calls"])]
    n, _ = frames(spark, nodes, [("a", "b", "calls")] * 5)
    p = spark.createDataFrame(rows, "query int, nth int, nodes array<string>, relations array<string>")
    q = spark.createDataFrame([(1, "what does app do"), (2, "where"), (3, "which tests are there")], "query int, text string")
    told = traces.scored(traces.described(p, n), q)
    got = {(r["query"], r["rank"]): r["summary"] for r in traces.chosen(told, 10).collect()}
    assert {v for (i, _), v in got.items() if i == 1} == {"app.A member app.A.m --possible-writes→ app.B", "app.A --calls→ app.B", "app.A --calls→ C"}
    assert got[(2, 1)] == "app.A member app.A.m"  # nothing else is there
    assert {v for (i, _), v in got.items() if i == 3} == {"app.A --calls→ T", "app.A --calls→ app.B"}  # the query asks for tests
    score = {(r["query"], r["nth"]): r["score"] for r in told.collect()}
    assert score[(1, 0)] == pytest.approx(5 * 18 + 105 * 0.7 + 18 * 0.25 - 2)
    assert score[(1, 2)] == pytest.approx(5 * 18 + 95 * 0.7 - 70 - 2)
    assert score[(1, 6)] == pytest.approx(5 * 18 + 95 * 0.7 + 18 * 0.25 - 2)


def test_choices_of_many_queries_are_dealt_over_tasks_and_streamed(spark):
    """Few rows of many queries: every task takes some, a query that lies in two batches keeps its state, rows come in order."""
    from pyspark.sql import functions as F

    def begin():
        seen = []

        def take(place, rank, next):
            seen.append((place, rank))
            return (next, "calls", "outgoing", place, len(seen), -1, seen == sorted(seen))

        return take

    rows = spark.range(40).select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(6), F.lit(0), F.lit(-1))).alias("rank"))
    rows = rows.select("query", (F.col("rank") % 2).cast("int").alias("place"), "rank", F.concat_ws("/", "query", "rank").alias("next"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = traces._chosen(rows, begin).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r["task"] for r in got}) == 4
    order = [0, 2, 4, 6, 1, 3, 5]
    assert sorted((r["query"], r["result"], r["next"]) for r in got) == [(q, i + 1, f"{q}/{n}") for q in range(40) for i, n in enumerate(order)]
    assert all(r["claimed"] for r in got)
