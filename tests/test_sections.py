"""Chunks, spans, signals and graph forms against plain loops."""

import random
import re

from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import graph, sections, signals


def plain_windows(lines):
    """Line by line: the last blank line so far is where a full window is cut."""
    out, start, boundary = [], 0, -1
    for i, line in enumerate(lines):
        boundary = i + 1 if not line.strip() else boundary
        if i - start + 1 == 48:
            end = boundary if boundary > start + 8 else i + 1
            out.append((start, end))
            start, boundary = end, -1
    return [*out, (start, len(lines))]


def plain_chunks(text):
    """(first line, last line, text) with a budget of 1536 tokens of four bytes."""
    body = re.sub(r"\n\Z", "", text.replace("\r\n", "\n"))
    if not body.strip():
        return []
    lines, out = body.split("\n"), []

    def fit(a, b):
        while a < b and not lines[a].strip():
            a += 1
        while b > a and not lines[b - 1].strip():
            b -= 1
        if a >= b:
            return
        size = lambda x, y: sections.bytes_over_four("\n".join(lines[x:y]))
        if size(a, b) <= 1536:
            out.append((a + 1, b, "\n".join(lines[a:b])))
        elif b - a == 1:
            out.extend((b, b, x) for x in sections.four_byte_pieces(lines[a]))
        else:
            fits = [m for m in range(a + 1, b) if size(a, m) <= 1536]
            if fits:
                fit(a, fits[-1])
                fit(fits[-1], b)
            else:
                out.extend((a + 1, a + 1, x) for x in sections.four_byte_pieces(lines[a]))
                fit(a + 1, b)

    for a, b in plain_windows(lines):
        fit(a, b)
    return out


def test_chunks_against_plain_loops(spark):
    r = random.Random(1)
    line = lambda: "" if r.random() < 0.1 else "x" * r.choice([3, 40, 300, 9000])
    texts = {f"f{i}": r.choice(["\n", "\r\n"]).join(line() for _ in range(r.choice([1, 5, 48, 49, 200]))) + r.choice(["", "\n"]) for i in range(60)}
    texts |= {"none": None, "empty": "", "blank": " \n\t\n", "long": "é" * 20_000}
    got = {}
    for x in sections.chunks(spark.createDataFrame(list(texts.items()), "path string, text string")).collect():
        got.setdefault(x.path, []).append((x.start_line, x.end_line, x.text))
        assert x.token_count <= 1536 or "é" in x.text
    assert got == {p: c for p, t in texts.items() if (c := plain_chunks(t or ""))}


def test_spans_against_plain_loops(spark):
    r = random.Random(2)
    kinds = ["test", "method", "function", "type", "constant", "other"]
    rows = [(f"p{i % 40}", (a := r.randrange(0, 34)), a + r.randrange(-2, 9), r.choice(kinds), r.choice("abc")) for i in range(600)]
    lines = spark.createDataFrame([(f"p{i}", 30) for i in range(40)], "path string, n_lines int")
    got = sorted(tuple(x) for x in sections.canonical_spans(spark.createDataFrame(rows, "path string, start_line int, end_line int, kind string, name string"), lines).collect())
    rank = lambda s: (-sections.SPAN_PRIORITY.get(s[2], 0), s[3], s[2])
    want = []
    for p in {x[0] for x in rows}:
        best = {}
        for _, a, b, kind, name in (x for x in rows if x[0] == p and 0 < x[1] <= 30):
            s = (a, min(max(a, b), 30), kind, name)
            if s[:2] not in best or rank(s) < rank(best[s[:2]]):
                best[s[:2]] = s
        leaves = [s for s in best.values() if not any(s[0] <= o[0] and s[1] >= o[1] and s[:2] != o[:2] for o in best.values())]
        kept = []
        for s in sorted(leaves, key=lambda s: (s[:2], rank(s))):
            if not kept or s[0] > kept[-1][1]:
                kept.append(s)
            elif (s[1] - s[0], *rank(s)) < (kept[-1][1] - kept[-1][0], *rank(kept[-1])):
                kept[-1] = s
        want += [(p, *s) for s in kept]
    assert got == sorted(want)


def test_span_chunks_cover_every_line(spark):
    text = "\n".join(f"line {i}" for i in range(1, 101))
    df = spark.createDataFrame([("a", text, [(10, 20, "function", "f"), (60, 60, "test", "t")])], "path string, text string, spans array<struct<start_line: int, end_line: int, kind: string, name: string>>")
    got = [(x.start_line, x.end_line, x.semantic_name) for x in sections.chunks(df).collect()]
    assert got == [(1, 9, ""), (10, 20, "f"), (21, 59, ""), (60, 60, "t"), (61, 100, "")]


def test_exact_search_against_plain_loops(spark):
    files = [(1, "src1/en/1.txt", "call parseHTTPRequest now"), (2, "src1/fr/2.txt", "parseHTTPRequest2 v1.2.0 v1.2.01"), (3, "x/server.port.txt", "server.port=8080 ERR_X"), (4, "x/4.txt", None), (5, "x/5.txt", 'say "the word" the word')]
    queries = [(1, "where is parseHTTPRequest"), (2, "v1.2.0 or server.port=1"), (3, 'find "the word"'), (4, "ERR_X in src1/en"), (5, '"->" x'), (6, "plain words")]
    made = signals.signals(spark.createDataFrame(queries, "query_id int, text string"))
    rows = made.collect()
    got = {(x.query_id, x.doc_id): x.score for x in signals.exact_search(spark.createDataFrame(files, "doc_id int, path string, text string"), made).collect()}
    tokens = lambda s: set(spark.range(1).select(T.tokens(F.lit(s)).alias("x")).first()["x"])
    want = {}
    for q, _ in queries:
        own = [x for x in rows if x.query_id == q]
        for i, path, text in files:
            have = tokens(f"{path} {text or ''}")
            if not (any(not tokens(x.value) for x in own) or any(tokens(x.value) <= have for x in own)):
                continue
            score = 0.0
            for x in own:
                score += x.weight + 1 if x.value in path else 0
                word = rf"(?<![A-Za-z0-9_]){re.escape(x.value)}(?![A-Za-z0-9_])"
                score += x.weight if (x.value in (text or "") if x.kind in ("quoted phrase", "path", "filename") else re.search(word, text or "")) else 0
            if score:
                want[q, i] = score
    assert got == want and got


def test_handles_that_are_none(spark):
    rows = spark.createDataFrame([("x",), ("cairnwork:v1:@@",), ("cairnwork:v1:e30",), (None,)], "h string")
    assert [x.p for x in rows.select(T.handle_payload(F.col("h"), "v int").alias("p")).collect()][0] is None


def test_chains_in_the_order_of_a_queue(spark):
    edges = [("a", "c", "calls"), ("a", "b", "calls"), ("b", "d", "possible-calls"), ("c", "d", "calls"), ("b", "d", "calls"), ("d", "a", "calls"), ("x", "a", "calls")]
    df = spark.createDataFrame(edges, "src string, dst string, relation string")
    starts = spark.createDataFrame([("a",), ("d",), ("x",), ("nowhere",)], "key string")
    got = {r.start: r.path for r in graph.shortest_chain(df, starts, "d", 3).collect()}
    assert got == {"a": "a>calls>b>calls>d", "d": "d", "x": "x>calls>a>calls>b>calls>d"}
    assert [r.path for r in graph.paths(df, "a", "d", 3, 2).collect()] == ["a>calls>b>calls>d", "a>calls>b>possible-calls>d"]
    assert [r.depth for r in graph.paths(df, "a", "a", 3).collect()] == [0]


def test_names_of_every_rank(spark):
    nodes = [("1", "Abc", "q.x", "p"), ("2", "x", "ABC", "p"), ("3", "x", "q", "abc"), ("4", "abcd", "q", "p"), ("5", "x", "abc.d", "p"), ("6", "x", "q", "abc\\d"), ("7", "xabc", "q", "p"), ("8", "x", "q.abc", "p"), ("9", "x", "q", "p/abc"), ("0", "x", "q", "p")]
    df = spark.createDataFrame(nodes, "key string, name string, qualified_name string, path string")
    assert {r.key: r["rank"] for r in graph.name_ranks(df, " aBc ").collect()} == {str(i + 1): i for i in range(9)}
    assert graph.name_ranks(df, "  ").count() == 0
    assert [r.key for r in graph.name_ranks(df, "abc\\D").collect()] == ["6"]


def test_impact_against_a_queue(spark):
    r = random.Random(9)
    edges = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice(["calls", "handled-by", "reads", "possible-calls"])) for _ in range(70)})
    near = {}
    order = lambda rel: 0 if rel == "handled-by" else 1 if "calls" in rel else 2
    for a, b, rel in edges:
        near.setdefault(a, set()).add((order(rel), b, rel))
        near.setdefault(b, set()).add((order(rel), a, rel))
    queue, seen, want = [("n0", 0)], {"n0"}, []
    while queue and len(want) < 12:
        node, depth = queue.pop(0)
        if depth >= 3:
            continue
        for _, other, rel in sorted(near.get(node, ())):
            if other not in seen and len(want) < 12:
                seen.add(other)
                want.append((len(want), other, depth + 1, rel))
                queue.append((other, depth + 1))
    df = spark.createDataFrame(edges, "src string, dst string, relation string")
    assert [tuple(x) for x in graph.impact_in_order(df, spark.createDataFrame([("n0",)], "key string"), 3, 12).orderBy("place").collect()] == want


def test_ignore_rules(spark):
    from cairnwork.sources import ignore

    control = [(".gitignore", "# c\n*.log\n/build\n!keep.log\ndocs/*.txt\ncache/\n**/deep/x?\n"), ("sub/.gitignore", "!*.log\nonly\n")]
    found = ignore.rules(spark.createDataFrame(control, "path string, text string"))
    paths = {
        "a.log": True, "x/a.log": True, "keep.log": False, "build": True, "build/a": True, "x/build": False, "docs/a.txt": True, "docs/x/a.txt": False, "cache/a": True, "x/cache/y/z": True,
        "cache": False, "a/deep/xy": True, "deep/xy": True, "sub/a.log": False, "sub/only": True, "only": False, "sub/x/only/y": True, "plain.go": False, "cache/keep.log": True,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.x for r in df.select("path", ignore.ignored(F.col("path"), found).alias("x")).collect()} == paths
