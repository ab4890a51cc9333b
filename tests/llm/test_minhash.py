import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import minhash
from cairnwork.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text, n):
    words = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n=4, percent=80):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted([(d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n int, cid int")
    got = sorted([tuple(r)[:4] for r in minhash.near_duplicates(docs, words=4).collect()], key=str)
    assert got == brute(rows)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return " ".join(out)


def test_cases(spark):
    base = [f"w{i}" for i in range(60)]
    check(spark, [
        (5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A\tB "), (10, "a b c"), (11, " ".join(base)), (4, " ".join([*base, "z"])),
        (12, " ".join(base).upper()), (12, " ".join(base)), (None, " ".join(base[1:])), (13, "É é"), (14, "é é"),
        (15, " ".join(f"v{i}" for i in range(30_000))), (16, " ".join(f"v{i}" for i in range(29_000))), (17, "a b c d"), (18, "a b c d a b c d"),
    ])


def test_families_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for f in range(25):
        base = [f"f{f}w{r.randrange(500)}" for _ in range(r.choice([12, 40, 120]))]
        for _ in range(r.choice([1, 3, 12])):
            rows.append((len(rows), edited(r, base, r.randrange(0, 4))))
    r.shuffle(rows)
    check(spark, rows)


def test_hot_family(spark):
    r = random.Random(4)
    base = [f"h{i}" for i in range(100)]
    rows = [(i, edited(r, base, r.choice([0, 1, 1, 2, 2, 3]))) for i in range(300)]
    check(spark, rows)


def test_star_family(spark):
    """Copies that are near their original alone: each must find it among thousands."""
    r = random.Random(5)
    base = [f"s{i}" for i in range(400)]
    rows = [(i, edited(r, base, r.choice([8, 9, 10])) if i != 1234 else " ".join(base)) for i in range(2000)]
    hub, sets = shingle_set(" ".join(base), 4), [shingle_set(t, 4) for _, t in rows]
    assert all(100 * len(s & hub) >= 80 * len(s | hub) for s in sets)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert got.select("component_id").distinct().count() == 1


def test_large_family_against_brute_force(spark):
    """1,400 copies with more or fewer edits: some are near few others, some none."""
    r = random.Random(8)
    base = [f"s{i}" for i in range(90)]
    check(spark, [(i, edited(r, base, r.choice([1, 2, 2, 3, 3, 4, 5, 6, 7]))) for i in range(1400)])


@pytest.mark.parametrize("wide", [1, 16])
def test_sketches_of_a_region_are_compared_in_full(spark, monkeypatch, wide):
    monkeypatch.setattr(minhash, "WIDE", wide)
    r = random.Random(6)
    rows = [(k, i + 100 * k, i % 7 if k else i, bytearray(r.choice([b"\0" * 64, b"\x11" * 64, b"\0" * 44 + b"\x11" * 20]))) for k in (0, 1) for i in range(90)]
    mixed = minhash._outside(spark.createDataFrame(rows, "region long, cid long, label long, sketch binary"), "region", F.lit(1))
    want = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]]
    likely = minhash.likely(np.array([np.frombuffer(s[3], np.uint8) for p in want for s in p]), np.arange(2 * len(want)).reshape(-1, 2), 0.8)
    want = [p for p, k in zip(want, likely, strict=True) if k]
    for part in (1, 10, 2048):
        got = minhash._alike(mixed, 0.8, part).collect()
        assert {x.cid for x in got} - {None} == {x[1] for p in want for x in p}
        joined, wanted = minhash.Roots(), minhash.Roots()
        for x in got:
            if x.a is not None:
                joined.join(x.a, x.b)
        for x, y in want:
            wanted.join(x[2], y[2])
        assert {x: joined.find(x) for x in wanted.up} == {x: wanted.find(x) for x in wanted.up}


@pytest.mark.parametrize("wide", [1, 16])
def test_clusters_are_compared_in_full(spark, monkeypatch, wide):
    monkeypatch.setattr(minhash, "WIDE", wide)
    r = random.Random(7)
    rows = []
    for i in range(120):
        own = np.unique([r.randrange(40) for _ in range(r.choice([20, 60, 90]))]).astype(np.uint64)
        rows.append((i % 2, i, i // 3, bytearray(own.tobytes())))
    kept = minhash._outside(spark.createDataFrame(rows, "cluster long, cid long, label long, hashes binary"), "cluster", F.octet_length("hashes"))
    sets = {x[1]: np.frombuffer(bytes(x[3]), np.uint64) for x in rows}
    want = minhash.Roots()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and minhash.jaccard_at_least(sets[x[1]], sets[y[1]], 80):
                want.join(x[2], y[2])
    for part in (100, 2000, 4 << 20):
        got = minhash.Roots()
        for x in minhash._joining(kept, 80, part).collect():
            assert minhash.jaccard_at_least(sets[x.a], sets[x.b], 80)
            got.join(x.a // 3, x.b // 3)
        assert {x: got.find(x) for x in want.up} == {x: want.find(x) for x in want.up}


def test_neighbours_across_batches(spark):
    rows = [(i // 50, bytearray([i // 8, i % 8] * 8), i, bytearray(64)) for i in range(100)]
    df = spark.createDataFrame(rows, "region long, key binary, cid long, sketch binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = {tuple(x) for x in minhash._neighbours(df, 0.8).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, i + 1) for i in range(99) if i != 49}


def test_table_against_brute_force(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 120), (None, 3)]
    for few in (0, 1000):
        got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), few=few).collect()}
        assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 120: 120, 150: 120, 200: 120}


def test_jaccard_bounds():
    x = np.arange(10, dtype=np.uint64)
    assert minhash.jaccard_at_least(x, x[:8], 80) and not minhash.jaccard_at_least(x, x[:7], 80) and not minhash.jaccard_at_least(x, x[:0], 80)
