import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from cairnwork.llm import spelling


def counted(rows, least_length=7, least=2, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= least and len(w) >= least_length}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=10):
    forms, out = {}, []
    beside = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    for w, others in beside.items():
        forms[w] = others[0] if others and n[others[0]] >= ratio * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n[w], len(beside[w]), forms[w], n[forms[w]] if forms[w] else None, root))
    return sorted(out, key=str)


def words_of(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_counted_words(spark):
    rows = [(1, None), (2, ""), (3, "Zebrafish zebrafish ZEBRAFISH short"), (4, "crème-brûlée " * 40), (4, "crème-brûlée " * 40), (None, "nullable " * 3),
            (5, "x" * 5000 + " " + "x" * 5000), (6, "über×maß÷gross ÜBERMÄSSIG Übermässig übermässig"), *[(i, "repeated repeater") for i in range(10, 200)]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, run string, h int")
    for every in (31, 2, 0):
        found = {r.word: r.n for r in spelling.count_words(docs, every=every).collect()}
        assert found == counted(rows, every=every)
    assert spelling.count_words(docs.limit(0)).count() == 0


def test_pairs_and_forms_against_brute_force(spark):
    n = {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaabaaa": 7, "aaaaaaab": 1000, "baaaaaaa": 1000, "abcdefg": 3, "bacdefg": 40, "abcdef": 900, "bcdefg": 30, "abcdefgh": 2,
         "abdcefg": 4, "gfedcba": 9, "xbcdefg": 33, "abcxdefg": 30, "éèêëçàü": 2, "éèêëçàu": 20, "éèêëçàüü": 19, "q" * 300: 2, "q" * 301: 20, "q" * 299 + "z": 1, "a": 1, "b": 12, "ab": 200}
    assert sorted([tuple(r) for r in spelling.variants(words_of(spark, n)).collect()], key=str) == brute(n)


def test_chains_of_any_length(spark):
    n = {"a" * k + "b" * (20 - k): 10**k for k in range(15)}
    found = {r.word: r for r in spelling.variants(words_of(spark, n)).collect()}
    assert {r.root for r in found.values()} == {"a" * 14 + "b" * 6}
    assert sorted([tuple(r) for r in found.values()], key=str) == brute(n)
    with pytest.raises(ValueError):
        spelling.variants(words_of(spark, n), ratio=1)


def test_anagrams_do_not_meet_all_at_once(spark):
    r = random.Random(3)
    n = {"".join(r.sample("abcdefghijkl", 12)): 2 for _ in range(3000)}
    keys = spelling.keyed(words_of(spark, n)).groupBy("key").count()
    assert keys.agg({"count": "max"}).first()[0] < 60  # all of these words are anagrams of one another


def test_a_pair_is_met_once(spark):
    n = {"".join(w): 2 for k in (3, 4, 5) for w in itertools.product("ab", repeat=k)} | {"".join(w): 3 for w in itertools.product("abc", repeat=4)}
    pairs = [(r.a, r.b) for r in spelling.near_pairs(words_of(spark, n)).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in n for b in n if a < b and near(a, b)}


def test_empty(spark):
    assert spelling.variants(words_of(spark, {"a": 1}).limit(0)).count() == 0


def test_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = counted(rows)
    found = {r.word: r for r in spelling.op13_spelling(spark, sf_dir).collect()}
    assert {w: r.n for w, r in found.items()} == want
    less = {}
    for w in want:
        for i in range(len(w)):
            less.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w, r in list(found.items())[::7]:
        beside = {x for x in want if len(x) == len(w) - 1 and x in {w[:i] + w[i + 1 :] for i in range(len(w))}} | less.get(w, set())
        beside |= {x for i in range(len(w)) for x in less.get(w[:i] + w[i + 1 :], ()) if near(w, x)}
        assert r.n_near == len(beside)
