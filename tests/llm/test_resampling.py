import hashlib
import math
import re
import zlib
from collections import Counter

from cairnwork.llm import resampling

SCHEMA = "doc_id long, text string, n_words int, weight int, id int, part int"


def features(text, ngrams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=10, least=20, ngrams=(1, 1), buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, ngrams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, found = features(text, ngrams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


def check(spark, rows, target, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, wanted, percent=options.get("percent", 10), least_words=options.get("least", 20),
                                ngrams=options.get("ngrams", (1, 1)), buckets=options.get("buckets", 10_000))
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows, target, **options)


ROWS = [
    (1, None), (2, ""), (3, " .,\n"), (4, "Ab aB AB ÀÉ àé 12a a1-b2 \U0001f600x"), (None, "null id here " * 9), (5, "one two three " * 8),
    (6, "one two three " * 8), (6, "one two three " * 8), (7, "x" * 40_000), (8, " ".join(f"w{i}" for i in range(9000))), (9, "a b"),
]


def test_cases_against_brute_force(spark):
    for options in ({}, {"percent": 50, "least": 1}, {"percent": 100, "least": 0, "ngrams": (1, 3), "buckets": 64}, {"ngrams": (2, 2), "least": 2, "percent": 34}):
        check(spark, ROWS, ["one two", None, "", "W5 w6 ab"], **options)


def test_empty_tables(spark):
    check(spark, ROWS, [])
    check(spark, [], ["a b"])


def test_ties_go_to_smaller_ids_across_ranges(spark):
    rows = spark.range(500).selectExpr("id", "cast(id % 3 as long) as score", "true as able")
    found = {r["id"]: r["rank"] for r in resampling.ranked(rows, rows["able"], 50).collect()}
    order = sorted(range(500), key=lambda i: (-(i % 3), i))
    assert found == {i: place + 1 if place < 250 else None for place, i in enumerate(order)}


def test_scoring_neither_explodes_nor_shuffles_documents(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = resampling.scored(docs, target)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
