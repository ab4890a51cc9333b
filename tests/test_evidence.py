"""The narrow budget against plain loops; excerpts, inspections and assessments on rows made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import evidence

ROWS = "query int, lane string, nth long, handle string, path string, label string, start_line long, end_line long"


def repeats(c, kept):
    low = lambda x: (x or "").strip().lower()
    for k in kept:
        if k["handle"] == c["handle"]:
            return True
        if not low(c["path"]) or low(c["path"]) != low(k["path"]):
            continue
        alike = low(c["label"]) != "" and low(c["label"]) == low(k["label"])
        if c["start_line"] is None or k["start_line"] is None:
            if alike:
                return True
        elif c["start_line"] <= k["end_line"] and k["start_line"] <= c["end_line"]:
            if alike or (c["start_line"], c["end_line"]) == (k["start_line"], k["end_line"]):
                return True
    return False


def budget(rows, limit):
    lanes, at, kept, out = {x: sorted((r for r in rows if r["lane"] == x), key=lambda r: r["nth"]) for x in evidence.LANES}, dict.fromkeys(evidence.LANES, 0), [], set()
    while len(kept) < limit:
        moved = False
        for lane in evidence.LANES:
            while at[lane] < len(lanes[lane]):
                c = lanes[lane][at[lane]]
                at[lane] += 1
                if repeats(c, kept):
                    out.add((c["query"], lane, c["nth"], "suppressed", None))
                    continue
                kept.append(c)
                out.add((c["query"], lane, c["nth"], "kept", len(kept)))
                moved = True
                break
            if len(kept) == limit:
                break
        if not moved:
            break
    return out


@pytest.mark.parametrize("limit", [1, 4, 50])
def test_narrow_budget_against_plain_loops(spark, limit):
    r = random.Random(limit)
    names = ROWS.replace(",", "").split()[::2]
    rows = []
    for q in range(12):
        for lane in evidence.LANES:
            for nth in range(r.randint(0, 9)):
                start = r.choice([None, *range(6)])
                rows.append(dict(zip(names, (q, lane, nth, f"h{r.randint(0, 15)}", r.choice(["", None, "a.go", " A.go", "b.go"]), r.choice(["", None, "X", "x ", "y"]), start, None if start is None else start + r.randint(0, 3)), strict=True)))
    got = {(x["query"], x["lane"], x["nth"], x["verdict"], x["pick"]) for x in evidence.narrow_budget(spark.createDataFrame([tuple(x.values()) for x in rows], ROWS), limit).collect()}
    assert got == set().union(*(budget([x for x in rows if x["query"] == q], limit) for q in range(12)))


def cut(text, most, ends, with_end):
    text = text.replace("\r\n", "\n").strip()
    data = text.encode()
    if len(data) <= most:
        return text
    head = data[:most].decode(errors="ignore").strip()
    at = max(head.rfind(c) for c in ends)
    if at >= 0 and len(head[:at].encode()) >= most // 2:
        head = head[: at + with_end].strip()
    return head + "…"


def test_excerpts(spark):
    texts = ["", "  short \r\n", "x" * 700, "x" * 701, "é" * 400, "a" + "é" * 400, "ab€" * 300, "word. " * 200, "x" * 300 + ". " + "y" * 600, "x" * 349 + "}" + "y" * 600, "x" * 350 + "}" + "y" * 600, "  " + "z;" * 500, "😀" * 200, "b" + "😀" * 200,
             "line\r\n" * 300, "a" * 690 + " " * 30 + "b" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most, ends, with_end in ((700, "\n.!?; }", True), (1200, "\n.!? ", False), (64, "\n.!?; }", True)):
        got = {r.i: r.x for r in df.select("i", evidence.compact(F.col("t"), most, ends, with_end).alias("x")).collect()}
        assert got == {i: cut(t, most, ends, with_end) for i, t in enumerate(texts)}


def test_inspections(spark):
    chunks = [("a.go", "1", 1, 3, "l1\r\nl2\nold3"), ("a.go", "2", 3, 5, "l3\nl4\nl5\nbeyond"), ("b.go", "1", 10, 10, "long "), ("b.go", "2", 10, 10, "line"), ("b.go", "3", 11, 12, "x\ny")]
    asked = [(1, "a.go", 2, 4), (2, "a.go", 0, 0), (3, "a.go", 5, 1), (4, "a.go", 5, 9), (5, "b.go", 10, 10), (6, "b.go", 3, 11), (7, "c.go", 1, 1), (8, "b.go", -1, 12)]
    got = {r["request"]: tuple(r)[2:] for r in evidence.inspected(
        spark.createDataFrame(asked, "request int, path string, start_line long, end_line long"),
        spark.createDataFrame(chunks, "path string, chunk_id string, start_line long, end_line long, text string"), 1).collect()}
    assert got == {
        1: (1, 5, None, "l1\nl2\nl3\nl4\nl5"), 2: (1, 2, None, "l1\nl2"), 3: (4, 5, None, "l4\nl5"), 4: (None, None, "outside", None), 5: (10, 11, None, "long line\nx"),
        6: (None, None, "outside", None), 7: (None, None, "no such path", None), 8: (10, 12, None, "long line\nx\ny"),
    }


def test_every_assessment(spark):
    core = ("symbol", "function", "f", "", "src/a.go", "", False)
    items = {1: [core], 3: [core], 4: [("symbol", "route", "", "", "x.md", "", False)], 5: [core], 7: [core, ("symbol", "", "", "", "x/tests/a.h", "", False)], 8: [core], 9: [("symbol", "document", "d", "", "readme.md", " ", False)]}
    requests = [(0, "orient", "balanced"), (1, "orient", "balanced"), (2, "search", "narrow"), (3, "search", "narrow"), (4, "search", "narrow"), (5, "search", "balanced"), (6, "inspect", ""), (7, "inspect", ""), (8, "inspect", ""), (9, "inspect", ""),
                (10, "trace", ""), (11, "impact", ""), (12, "trace", ""), (13, "unknown", "")]
    got = {r["request"]: r for r in evidence.assessed(
        spark.createDataFrame(requests, "request int, mode string, breadth string"),
        spark.createDataFrame([(q, *x) for q, xs in items.items() for x in xs], "request int, provider string, kind string, name string, qualified_name string, path string, excerpt string, inspected boolean"),
        spark.createDataFrame([(11, 3, 1), (12, 2, 0)], "request int, found long, unresolved long")).collect()}
    cases = [("orient", "none"), ("orient", "some"), ("search", "none"), ("search", "narrow core"), ("search", "narrow"), ("search", "some"), ("inspect", "none"), ("inspect", "all"), ("inspect", "core"), ("inspect", "some"), ("expand", "none"), ("expand", "gaps"), ("expand", "some")]
    assert {i: (got[i]["status"], got[i]["next_action"], got[i]["reason"]) for i in range(13)} == {i: evidence.ASSESSMENTS[c] for i, c in enumerate(cases)}
    assert 13 not in got and set(cases) == set(evidence.ASSESSMENTS)
    assert got[7]["observed"] == list(evidence.DIMENSIONS) and got[8]["missing"] == ["public_boundary", "tests"] and got[9]["observed"] == [] and got[7]["distinct_paths"] == 2
