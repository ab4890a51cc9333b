import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnwork.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, tok, rows, **options):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, position int")
    got = sorted([tuple(r) for r in bpe.round_trip(docs, PATH, **options).collect()], key=str)
    want = []
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


CASES = [
    (1, None), (2, ""), (3, "  \n\t x  y"), (4, "Hello, don't stop'll now"), (5, "<|endoftext|>a <|endoftext|><|endoftext|>"),
    (6, "漢字 かな 🙂🙂 é ​ x"), (7, "x" * 5000), (8, "same words same words"), (8, "same words same words"),
    (None, "no id é ß Ω İ"), (9, "1234 ½ ² \x1c\x1f\x85 end "), (10, "wörd " * 3000),
]


def test_cases(spark, tok):
    check(spark, tok, CASES)
    check(spark, tok, CASES, head=3)


def test_table_with_a_small_head(spark, tok, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, tok, rows, head=200)


def test_hot_words_longer_than_the_head_takes(spark, tok):
    rows = [(i, f"{'=' * 90} start{i} {'word' * 30}") for i in range(200)]
    check(spark, tok, rows)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", "some words"), (None, "a b")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, PATH).collect()} == {"x": 2, None: 2}


def test_decode_and_empty_table(spark):
    docs = spark.createDataFrame(CASES[:4], "doc_id long, text string")
    got = {r.id: r.text for r in bpe.decode_rows(bpe.encode_rows(docs, PATH), PATH).collect()}
    assert got == {i: t or "" for i, t in CASES[:4]}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_the_text_does(text):
    v = bpe.Vocabulary.load(PATH)
    words = v.split(text)
    assert "".join(words) == text
    assert [i for e in v.tokenizer.encode_batch_fast(words, add_special_tokens=False) for i in e.ids] == v.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(120, 140), st.integers(16_380, 16_390), st.integers(0, (1 << 21) - 1)), max_size=9), max_size=5))
def test_numbers_round_trip(rows):
    assert [bpe.numbers_of(x).tolist() for x in bpe.numbers(rows)] == rows
