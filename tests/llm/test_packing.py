import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnwork.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, **options):
    tok = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, room int")
    got = packing.pack(docs, PATH, **options).collect()
    capacity = options.get("capacity", packing.CAPACITY)
    want = sorted([[r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]] for r in rows], key=str)
    by_doc = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, ids in want:
        if sum(r[0] == doc for r in rows) == 1:
            pieces = sorted(by_doc[doc], key=lambda p: p.start)
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
            packed = b"".join(bytes(p.ids) for p in pieces)
            assert np.frombuffer(packed, "<u4").tolist() == ids and {p.doc_tokens for p in pieces} == {len(ids)}
            assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0 for p in pieces)
    assert sum(p.length for p in got) == sum(len(x) for _, x in want)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return got, sequences


def test_cases(spark):
    check(spark, [
        (1, None), (2, ""), (3, "Hello World, it's 42!"), (4, "ÀÉ İstanbul ΑΣ é 漢字 <|endoftext|> x"), (5, "word " * 9000),
        (None, "no id"), (6, "a b \x1c   c"), (7, "x y z " * 700), (8, "tie"), (9, "tie"),
    ])
    check(spark, [(i, f"tiny {i}") for i in range(40)], capacity=64)


def test_rests_go_up_a_tree(spark):
    """More workers than FAN ** 2, ids of another type."""
    docs = spark.createDataFrame([(f"d{i}", f"tiny {i}") for i in range(700)], "doc_id string, text string").repartition(300)
    got = packing.pack(docs, PATH, capacity=64).collect()
    assert len(got) == 700 and {p.doc_id for p in got} == {f"d{i}" for i in range(700)}
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in sequences.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 64
    assert sum(p.length for p in got) >= 0.9 * 64 * (len(sequences) - 1)


def test_repeated_rows_and_empty_table(spark):
    got, _ = check(spark, [(1, "twice"), (1, "twice")])
    assert len(got) == 2
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_little_padding(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _, sequences = check(spark, rows)
    used = sum(n for s in sequences.values() for _, n in s)
    assert used >= 0.9 * 4096 * (len(sequences) - 1)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 30_000), st.integers(1, 200))
def test_cuts(n, waste):
    room = packing.rooms(4096)
    pieces = packing.cuts(n, 4096, waste, room)
    assert sum(pieces) == n and all(0 < p <= room[p] <= 4096 for p in pieces)
    assert all((room[p] - p) * waste <= p for p in pieces)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("aZ' st9,\n\x1c\x1fȺİé你́")), max_size=30), max_size=6))
def test_ids_are_the_library_s(texts):
    t = packing.WordTokenizer.load(PATH)
    t.HELD, t.words, t.old_words = 5, {}, {}  # generations of the cache change all the time
    for _ in range(2):
        assert t.encode(texts) == [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_workers_write_what_they_pack_and_keep_no_words(spark, monkeypatch):
    """The pieces' table takes one Python worker a task, and that holds no words for its next task."""
    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.words) + len(t.old_words) for t in packing.WordTokenizer._loaded.values())])], names=["n"])

    inner, materialize = [], packing.common.materialize

    def noted(df, *args, **options):
        inner.append("MapInArrow" in df._jdf.queryExecution().analyzed().toString())
        return materialize(df, *args, **options)

    monkeypatch.setattr(packing.common, "materialize", noted)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(80)], "doc_id long, text string").repartition(8)
    assert packing.pack(docs, PATH).count() == 80
    assert len(inner) >= 2 and not inner[0]
    assert sum(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()) == 0
