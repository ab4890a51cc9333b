import random

import numpy as np
import public_tokenizers
import pytest

from cairnwork.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'re", "'ll", "'ve", "'d", "<|endoftext|>", "<|endof", "  ", "\n\n", "the", "ing", " a", "'r", "'l", "\r\n", "'T", "''"]
LETTERS = "abcdefghijklmnopqrstuvwxyz'''   \n\t.,!12 éüß你好АБ 　ⅷ²\x1c\x85\U0001f600é"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def made(seed, n, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) if r.random() < 0.3 else r.choice(LETTERS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1024])
def test_any_chunks_count_as_the_library_does(library, chunk):
    texts = made(chunk, 1500)
    assert tc.Counter.load(PATH, 1 << 16).count(texts, chunk).tolist() == library(texts)


def test_a_full_table_is_emptied_and_counts_stay(library):
    texts = made(50, 800)
    small = tc.Counter(PATH, 500)
    assert small.count(texts, 16).tolist() == library(texts)
    assert len(small.known) <= 500 + 2 * len(texts)


def test_long_pretokens_and_long_texts(library):
    texts = ["a" * 30_000 + "é" * 5_000 + " " * 9_000, "", "ab" * 40_000, "x y " * 30_000, "'" * 5_000 + "s", "\n" * 7_000 + "z"]
    assert tc.Counter.load(PATH, 1 << 16).count(texts).tolist() == library(texts)


def test_the_maps_of_chunks_compose_to_a_run_over_the_whole():
    r = np.random.default_rng(5)
    classes = r.integers(0, tc.ADDED + 1, 400).astype(np.uint8)
    whole = tc.pretoken_starts(classes, np.array([0, 150]), np.array([150, 250]), 400)
    for chunk in (1, 2, 5, 64):
        assert (tc.pretoken_starts(classes, np.array([0, 150]), np.array([150, 250]), chunk) == whole).all()


def test_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "<|endoftext|>"), (4, "w " * 1100), (5, " \n\t "), (6, "don't 'll''s <|endoftext|><|endoftext|> x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_bytes int, id int")
    found = sorted([tuple(r) for r in tc.count_tokens(docs, PATH).collect()], key=str)
    counts = library([t or "" for _, t in rows])
    assert found == sorted([(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, counts, strict=True)], key=str)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0


def test_table_against_the_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = dict(zip([r.doc_id for r in rows], library([r.text or "" for r in rows]), strict=True))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op11_token_counts(spark, sf_dir).collect()}
    assert found == {r.doc_id: (len((r.text or "").encode()), counts[r.doc_id], counts[r.doc_id] > 1024) for r in rows}
