import hashlib
import re

from cairnwork.llm.exact_dedup import exact_groups

SCHEMA = "doc_id long, text string, size int, salt int, bucket string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in rows]
    groups = {}
    for r, n in zip(rows, norm):
        groups.setdefault(n, []).append(r)
    out = []
    for r, n in zip(rows, norm):
        best = min(groups[n], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out.append((r[0], best, len(groups[n]), r[0] == best, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cases_against_brute_force(spark):
    rows = [
        (1, "a b c"), (2, "abc"), (3, "ab\tc\n"), (4, None), (5, ""), (6, " \n"), (7, "a bc"), (8, "abd"), (8, "abd"),
        (None, "zz"), (9, "z z"), (10, "é" * 50_000), (11, "é" * 50_000 + " "), (12, "é" * 49_999 + "e"), (13, "solo"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    found = exact_groups(docs, digest_all=True, prefix=2, least_bits=15)
    assert sorted([tuple(r)[:5] for r in found.collect()], key=str) == brute(rows)


def test_only_survivors_are_hashed(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "a a"), (3, "longer alone")], "doc_id long, text string")
    found = {r.doc_id: r.text_sha256 for r in exact_groups(docs).collect()}
    assert found[3] is None and found[1] == found[2] is not None


def test_hot_group_and_empty_table(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_groups(docs, digest_all=True).filter("kept").count() == 2001
    assert exact_groups(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_bitmap_grows_with_the_rows_up_to_a_bound(spark):
    def slots(n, **limits):
        docs = spark.range(n).selectExpr("id AS doc_id", "cast(id % 7 as string) AS text")
        plan = exact_groups(docs, **limits)._jdf.queryExecution().optimizedPlan().toString()
        return {int(x) for x in re.findall(r"pmod\(xxhash64\(n_norm[^)]*\), (\d+)\)", plan)}

    assert slots(100) == {1 << 20}
    assert slots(1000, least_bits=4) == {1 << 13}
    assert slots(1000, least_bits=4, most_bits=9) == {1 << 9}
