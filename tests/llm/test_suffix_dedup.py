import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnwork.llm import suffix_dedup as sd


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length, **options):
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, at int, doc int")
    got = sorted([tuple(r)[:5] for r in sd.remove_repeats(docs, length=length, **options).collect()], key=str)
    assert got == brute(rows, length)


def test_cases(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, other = word(60), word(25)
    rows = [
        (1, None), (2, ""), (3, "short"), (4, word(30) + passage + word(9)), (5, word(3) + passage), (6, passage[7:] + word(40)),
        (7, "a" * 500), (8, "ab" * 90 + word(50)), (9, word(300)), (9, "same row twice, long enough to repeat " + "x"), (9, "same row twice, long enough to repeat " + "x"),
        (None, other + word(20) + other), (10, word(50) + passage[:33] + word(50) + passage[30:]), (11, passage + passage),
    ]
    for length in (20, 31):
        check(spark, rows, length)
        check(spark, rows, length, group=1)


def test_near_copies_and_partners_that_differ_by_side(spark, monkeypatch):
    r = random.Random(2)
    base = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(60)) for _ in range(300)]
    rows = []
    for i in range(40):
        own = list(base[r.randrange(100) : 200 + r.randrange(100)])
        for _ in range(r.randrange(12)):
            own[r.randrange(len(own))] = f"edit{r.randrange(1000)}"
        rows.append((i, " ".join(own)))
    check(spark, rows, 50)
    check(spark, rows, 50, group=2)
    monkeypatch.setattr(sd, "RANGE_BYTES", 2000)  # many ranges
    check(spark, rows, 50)


def test_production_length_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows, sd.LENGTH)


def test_kept_text_and_empty_table(spark):
    rows = [(1, "é" * 3 + "0123456789" * 3), (2, "0123456789" * 3 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.remove_repeats(docs, length=25, with_text=True).collect()}
    assert got[1].kept_text == "ééé" and got[2].kept_text == "x" and [tuple(s) for s in got[1].spans] == [(6, 36)]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def entries(words):
    return [(w, [sd.Place(i, i + 9, 0, len(w) % 3, b"xy"[: len(w) % 3])] * (1 + i % 2)) for i, w in enumerate(sorted(set(words)))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=12).map(str.encode), max_size=12), min_size=1, max_size=6))
def test_loser_tree_merges_and_knows_common_prefixes(runs):
    merged = list(sd.loser_tree([sd.front_decode(sd.front_code(entries(r))) for r in runs if r]) if any(runs) else [])
    flat = [m[1] for m in merged]
    assert flat == sorted(w for r in runs for w in set(r))
    for a, b in zip(merged, merged[1:]):
        assert b[0] == sd.common_prefix(a[1], b[1])


def test_front_coding_round_trip():
    made = entries([b"abc", b"abd", b"ab", b"x"])
    back = list(sd.front_decode(sd.front_code(made)))
    key = lambda p: (p.doc, p.at, p.near, p.far, p.before)
    assert [(w, [key(p) for p in ps]) for _, w, ps in back] == [(w, [key(p) for p in ps]) for w, ps in made]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=0, max_size=120).map(str.encode))
def test_every_start_has_one_anchor_that_its_string_fixes(data):
    length, window = 20, 12
    found = sd.find_anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length, window)
    place = {}
    for at, first, last, _ in zip(*(x.tolist() for x in found)):
        for i in range(first, last + 1):
            assert i not in place and 0 <= at - i < window
            place[i] = at - i
    assert sorted(place) == list(range(len(data) - length + 1))
    by = {}
    for i, d in place.items():
        assert by.setdefault(data[i : i + length], d) == d
