"""Byte-level BPE by a distinct-word table: split in Spark, encode each distinct word once, join ids back by position.

1. Every document is split into pre-tokens ("words"). Each task counts its words and sends those it met twice or more
   to a global count; the `head` most frequent, at most `head_bytes` bytes each, form the head of the distinct-word
   table. Its size is bounded by these two parameters, so it is encoded at once and broadcast.
2. All other occurrences travel as (row, position, word), dealt by word and sorted: each distinct word is encoded once
   where its run begins, and the ids go back under (row, position). A short word frequent enough to be hot is in the
   head; words over head_bytes bytes, which the head leaves out, are dealt over SALTS tasks by their row, so that no
   key of this exchange is hot.
3. Each text goes on as its words' places in the head, of one byte to three each, with holes for the tail, and meets the
   ids of its tail words in one exchange by row, sorted by position: it comes first, then its tail's ids as the stream
   goes by. The head is looked up, and ids stand in order of position.
4. Decoding joins ids with the id-to-piece table by Arrow's take: the table is that of the vocabulary, so of a fixed
   size and at hand in every worker, and the pieces of a batch come out one after another as the text.

Words come from a pattern equal to the vocabulary's for plain Latin text and from the tokenizer's own
pre-tokenizer for anything else; the strings of added tokens are cut out first, as the library does.

Cases: null and empty texts give no tokens. Rows are identified by 64-bit hashes of the id and of the text, so repeated
rows each get the full result and a null id is no obstacle. Very long texts are a batch of their own. An empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

IDS = "<u4"
SALTS = 16


class Vocabulary:
    """A byte-level BPE tokenizer file: word splitting, encoding of words, pieces of ids."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the vocabulary's pattern for plain text, on which the standard library's engine is twice as fast
        letters, numbers = common.LETTERS, common.NUMBERS
        self._words = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")
        self._plain = re.compile(r"[\x00-\x1b\x20-\x7e¡-ɏ]*")
        self._added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text in order, added tokens as words of their own."""
        if self._added and any(x in text for x in self.added):
            return [w for part in self._added.split(text) for w in ([part] if part in self.added else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f\x7f") or self._plain.fullmatch(text):
            return self._words.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    @property
    def narrow(self) -> str:
        """The type that the ids of words travel in."""
        return "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else IDS

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, packed as numbers of the type `narrow`."""
        return [np.array(e.ids, self.narrow).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if not hasattr(self, "_pieces"):
            # the byte alphabet: printable bytes stand for themselves, the others for code points from 256 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            table = [b""] * self.tokenizer.get_vocab_size()
            for piece, i in self.tokenizer.get_vocab().items():
                table[i] = piece.encode() if piece in self.added else bytes(back[c] for c in piece)
            self._pieces = table
        return self._pieces

    def tables(self) -> tuple[pa.Array, pa.Array]:
        """By id: its piece, and its decimal digits with a comma."""
        if not hasattr(self, "_tables"):
            self._tables = pa.array(self.pieces(), pa.binary()), pa.array([b"%d," % i for i in range(len(self.pieces()))], pa.binary())
        return self._tables


def numbers(rows: list[list[int]]) -> Iterator[bytes]:
    """Each row's numbers (below 2^21) as bytes of seven bits, the lowest first, the last of a number below 128."""
    flat = np.fromiter(chain.from_iterable(rows), np.uint32)
    n = 1 + (flat >= 1 << 7).astype(np.int64) + (flat >= 1 << 14)
    ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    out = np.zeros(ends[-1], np.uint8)
    for i in range(3):
        some = np.flatnonzero(n > i)
        out[ends[some] + i] = (flat[some] >> np.uint32(7 * i) & np.uint32(127)) | np.where(n[some] > i + 1, 128, 0)
    at = ends[np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in rows], dtype=np.int64)))].tolist()
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield out[i:j].tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    """The numbers of one row."""
    b = np.frombuffer(data, np.uint8)
    last = b < 128
    number = np.cumsum(last) - last  # which number each byte is of
    start = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(b) else np.zeros(0, np.int64)
    out = np.zeros(len(start), np.int64)
    np.add.at(out, number, (b & 127).astype(np.int64) << 7 * (np.arange(len(b)) - start[number]))
    return out


def _joined(table: pa.Array, ids: list[bytes]) -> Iterator[bytes]:
    """What the table has for the ids of each row, one after another."""
    bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
    taken = table.take(pa.array(np.frombuffer(b"".join(ids), IDS)))
    if not len(taken):
        yield from [b""] * len(ids)
        return
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[taken.offset + bounds]
    view = memoryview(data) if data is not None else memoryview(b"")
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(view[i:j])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): the last two name a row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("id"), "k2": F.xxhash64("text")})


def head_words(rows: DataFrame, vocabulary: str, head: int, head_bytes: int, held: int = 400_000) -> list[str]:
    """The most frequent words, at most `head` of at most head_bytes bytes each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = Vocabulary.load(vocabulary), Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= head_bytes]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in common.slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen.update(v.split(text))
            if len(seen) > held:
                yield out()
        yield out()

    counts = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.octet_length("word") <= head_bytes).orderBy(F.desc("n"), "word").limit(head)
    return top.select("word").toArrow().column("word").to_pylist()


def encode_rows(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *,
    head: int = 400_000, head_bytes: int = 32,
) -> DataFrame:
    """id, ids (packed 32-bit little-endian numbers) of every row."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    words = head_words(rows, vocabulary, head, head_bytes)
    known = spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words)})
    heads = spark.sparkContext.broadcast([b"", *Vocabulary.load(vocabulary).encode(words)])

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words_known = Vocabulary.load(vocabulary), known.value
        for batch in common.slices(batches, "text"):
            row, position, words = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [x for x in enumerate(v.split(text)) if x[1] not in words_known]
                row += [i] * len(found)
                position += [at for at, _ in found]
                words += [w for _, w in found]
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(row), batch.column("k2").take(row), pa.array(position, pa.int32()), pa.array(words, pa.string())],
                names=["k1", "k2", "position", "word"],
            )

    kind = dict(rows.dtypes)["id"]
    kind_arrow = rows.select("id").limit(0).toArrow().schema.field("id").type

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: each run of one word is encoded once."""
        v, last, last_ids = Vocabulary.load(vocabulary), None, b""
        for batch in batches:
            runs = batch.column("word").dictionary_encode()
            distinct = runs.dictionary.to_pylist()
            known_first = distinct and distinct[0] == last
            ids = ([last_ids] if known_first else []) + v.encode(distinct[1:] if known_first else distinct)
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k1", "k2", "position")), pa.nulls(batch.num_rows, kind_arrow), pa.array(ids, pa.binary()).take(runs.indices)],
                names=["k1", "k2", "position", "id", "payload"],
            )

    columns = f"k1 long, k2 long, position int, id {kind}, payload binary"
    occurrences = rows.mapInArrow(tail, "k1 long, k2 long, position int, word string")
    salt = F.when(F.octet_length("word") > head_bytes, F.pmod("k1", F.lit(SALTS))).otherwise(0)
    encoded = (
        occurrences.withColumn("salt", salt).repartition(common.shuffle_partitions(spark), "word", "salt").drop("salt")
        .sortWithinPartitions("word").mapInArrow(encode_runs, columns)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        v, place, packer = Vocabulary.load(vocabulary), known.value.get, zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text"):
            codes = [list(map(place, v.split(t), repeat(0))) for t in batch.column("text").to_pylist()]
            packed = pa.array([packer.compress(x) for x in numbers(codes)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(np.full(batch.num_rows, -1, np.int32)), batch.column("id"), packed],
                names=["k1", "k2", "position", "id", "payload"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's text (more than once if the row is repeated), then the ids of its tail words."""
        import zstandard

        v, head, unpack = Vocabulary.load(vocabulary), heads.value.__getitem__, zstandard.ZstdDecompressor()
        row, own, held, done, size = None, [], [], [], 0

        def finish() -> None:
            if own:
                ids = np.frombuffer(b"".join(held), v.narrow).astype(IDS).tobytes()
                done.extend((i, ids) for i in own)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind_arrow), pa.array([x for _, x in done], pa.binary())], names=["id", "ids"])
            done.clear()
            return made

        for batch in batches:
            for k1, k2, position, i, payload in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "position", "id", "payload")), strict=True):
                if position < 0:
                    if (k1, k2) == row:
                        own.append(i)
                        continue
                    finish()
                    size += 4 * len(held)
                    if size > 1 << 20:
                        yield out()
                        size = 0
                    row, own, held = (k1, k2), [i], list(map(head, numbers_of(unpack.decompress(payload)).tolist()))
                else:
                    held[position] = payload
        finish()
        yield out()

    met = rows.mapInArrow(pack, columns).unionByName(encoded).repartition(common.shuffle_partitions(spark), "k1", "k2")
    return met.sortWithinPartitions("k1", "k2", "position").mapInArrow(assemble, f"id {kind}, ids binary")


def decode_rows(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """id, text: every id replaced by its piece, bytes read as UTF-8 (ill-formed ones as U+FFFD)."""
    kind = dict(encoded.dtypes)["id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, _ = Vocabulary.load(vocabulary).tables()
        for batch in common.slices(batches, "ids"):
            texts = [x.decode(errors="replace") for x in _joined(piece, batch.column("ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(decode, f"id {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Digests of every row's ids and of the text that they decode to, in one pass over the encoded rows."""
    encoded = encode_rows(docs, vocabulary, id_col, text_col, **options)
    kind = dict(encoded.dtypes)["id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, digits = Vocabulary.load(vocabulary).tables()
        for batch in common.slices(batches, "ids"):
            ids = batch.column("ids").to_pylist()
            of_ids = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(digits, ids)]
            of_text = [hashlib.sha256(x.decode(errors="replace").encode()).hexdigest() for x in _joined(piece, ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(digest, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
