"""Routes of producers and endpoints against a plain loop, with one shape that most have."""

import random

from cairnwork.operators import facts


def test_contracts(spark, monkeypatch):
    monkeypatch.setattr(facts, "PAIRS", 500, raising=False)
    r = random.Random(5)
    shape = lambda: r.choice(["/a"] * 6 + ["/b", "/c", None])
    producers = [(r.randrange(90), shape(), r.choice(["", "GET", "POST", None])) for _ in range(200)]
    endpoints = [(r.randrange(70), shape(), r.choice(["*", "GET", "PUT", None])) for _ in range(150)]
    want = {(p, e) for p, s, m in producers for e, t, n in endpoints if s and s == t and (m == "" or n == "*" or (m and m == n))}
    out = facts.contracts(spark.createDataFrame(producers, "producer int, shape string, method string"), spark.createDataFrame(endpoints, "endpoint int, shape string, method string"))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = out.groupBy().count(), out.rdd.glom().map(len).collect()
    assert max(sizes[1]) < len(want) / 2  # no task has most of the one shape's pairs
