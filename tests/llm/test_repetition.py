import re
from collections import Counter

from cairnwork.llm import repetition as rp
from cairnwork.llm.repetition import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def covered(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= set(range(i, i + n))
    return inside


def brute(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, words))
    repeat = len(covered(words, 8))
    base = len(words) < 20 or 100 * repeat > 30 * len(words)
    share = {n: sum(len(words[i]) for i in covered(words, n)) / max(chars, 1) for n in rp.NGRAM_LIMITS}
    bad = any(share[n] > x for n, x in rp.NGRAM_LIMITS.items()) or dup_chars / max(chars, 1) > rp.LINE_LIMIT
    return (doc_id, len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, base, not base and not bad)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = sorted([tuple(r)[:8] for r in quality(docs).collect()], key=str)
    assert got == sorted([brute(*r) for r in rows], key=str)


def test_cases(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    check(spark, [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (5, f"{ten} x {ten} y z"), (6, "lïne ünö\nlïne ünö\n\nlïne ünö\n" * 3),
        (7, "# $ %% <> || é&é x"), (8, " ".join(map(str, range(40)))), (8, " ".join(map(str, range(40)))), (None, "w " * 8),
        (9, " ".join(map(str, range(20_000))) + " 1 2 3 4 5 6 7 8 9"), (10, "\x0b a\x0bb \n \n"), (11, f"{ten} {ten}"),
    ])


def test_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: r.n_words for r in quality(docs).collect()} == {"x": 2, None: 0}


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
