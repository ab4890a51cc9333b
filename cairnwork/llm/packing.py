"""Harmonic packing: lengths fall into reciprocal-capacity classes; a class's bins take a fixed count of pieces.

A sequence holds at most `capacity` tokens. A piece of length in (capacity/(j+1), capacity/j] is of class j, and a bin
of class j is full with j pieces, whatever they are: no length has to be compared with a bin's room. So each worker
fills bins of every class by itself.

Documents are cut where that saves padding: whole capacities first; then, while a rest would leave more than
1/`waste` of itself empty in its class, a piece of exactly the next class's size is cut off. At most the last piece of
a document is inexact.

First each worker fills the bins of its own pieces; the table of pieces is then written to the shared folder. What is
left in unfilled bins, at most j - 1 pieces per worker and class, goes up a tree: FAN workers' rests of a class meet in
one task and are filled in the same way, until one group is left, so that no task gets more than FAN * (j - 1) pieces
of a class however many workers there were. What is left then, at most j - 1 pieces per class in all (a constant: under
15,000 pieces at 4096), is put into shared sequences, longest first, each going into the open sequence or a new one.

Cases: a null text is an empty one, which yields one piece of the end token alone. Rows are independent, so repeated
rows and null ids are packed like any other. Very long texts are cut into many pieces. An empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

CAPACITY = 4096
END_ID = 2
WASTE = 64
FAN = 16
IDS = "<u4"
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, room int, worker int, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts under a tokenizer whose words are independent of each other, with a bounded word cache."""

    _loaded: dict[str, WordTokenizer] = {}
    HELD = 250_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # text with these goes to the library whole: added tokens, and controls that only Python takes for white space
        self.others = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + list("\x1c\x1d\x1e\x1f")
        # the split of the vocabulary file's pre-tokenizer, for plain text in lower case
        self._words = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{common.LETTERS}]+|[{common.NUMBERS}]|[^\s{common.LETTERS}{common.NUMBERS}]+")
        # text that normalises to its lower case alone, which is in this range too
        self._plain = re.compile(r"[\x00-\x1b\x20-\x7e¡-įı-ž]*")
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _each(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        """Ids of each word: many are encoded as one text of words between spaces, and its ids parted where words end."""
        parts = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, IDS)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            assert len(ends) == len(part), "the tokenizer splits words otherwise"
            bounds, data = [0, *(4 * ends).tolist()], ids.tobytes()
            out += [data[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def forget(self) -> None:
        """Let go of the words: Spark deals tasks to its idle workers in turn, and each would hold some."""
        self.words, self.old_words = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian 32-bit numbers, as encode(add_special_tokens=False) gives them."""
        words = [self._words.findall(t.lower()) if (t.isascii() or self._plain.fullmatch(t)) and not any(x in t for x in self.others) else None for t in texts]
        if len(self.words) > self.HELD:  # the words met again come back out of the old generation
            self.words, self.old_words = {}, self.words
        new = {w for ws in words for w in set(ws or ()).difference(self.words)}
        self.words.update((w, self.old_words[w]) for w in new if w in self.old_words)
        missing = [w for w in new if w not in self.words]
        self.words.update(zip(missing, self._each(missing), strict=True))
        others = [t for t, ws in zip(texts, words, strict=True) if ws is None]
        whole = (np.array(e.ids, IDS).tobytes() for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        get = self.words.__getitem__
        return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in words]


def rooms(capacity: int) -> np.ndarray:
    """For each length, the room that a piece of it takes: the largest share capacity // j it fits in."""
    room = np.zeros(capacity + 1, np.int64)
    length = np.arange(1, capacity + 1)
    room[1:] = capacity // (capacity // length)
    return room


def cuts(n: int, capacity: int, waste: int, room: np.ndarray) -> list[int]:
    """Lengths of the pieces, in order, of a document of n tokens."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        taken = int(room[rest])
        if (taken - rest) * waste > rest:
            exact = capacity // (capacity // rest + 1)  # the next class down: shorter than the rest
            pieces.append(exact)
            rest -= exact
        else:
            pieces.append(rest)
            rest = 0
    return pieces


class Bins:
    """Unfilled bins of one worker: fill() gives a sequence once a class has its count."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next_id = capacity, worker << 32
        self.open: dict[int, list[dict]] = defaultdict(list)

    def add(self, piece: dict) -> list[dict]:
        held = self.open[piece["room"]]
        held.append(piece)
        return self.close(self.open.pop(piece["room"])) if len(held) == self.capacity // piece["room"] else []

    def close(self, pieces: list[dict]) -> list[dict]:
        at = 0
        for p in pieces:
            p["sequence_id"], p["offset"] = self.next_id, at
            at += p["length"]
        self.next_id += 1
        return pieces

    def rest(self) -> list[dict]:
        return [p for held in self.open.values() for p in held]


def _arrow_schema(id_kind: pa.DataType, with_ids: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([("doc_id", id_kind)] + [(n, kinds[k]) for n, k in (f.split() for f in SCHEMA.split(", "))] + [("ids", pa.binary())] * with_ids)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *,
    capacity: int = CAPACITY, end_id: int = END_ID, waste: int = WASTE, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id (of the id's own type), SCHEMA without worker, and with_ids its ids as packed little-endian 32-bit numbers."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = _arrow_schema(narrow.select("id").limit(0).toArrow().schema.field("id").type, with_ids)
    columns = f"doc_id {dict(narrow.dtypes)['id']}, {SCHEMA}" + ", ids binary" * with_ids
    room = rooms(capacity)
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        t, bins = WordTokenizer.load(tokenizer), Bins(capacity, worker)
        end = np.array([end_id], IDS).tobytes()
        for batch in common.slices(batches, "text", 1 << 20):
            out: list[dict] = []
            for doc, ids in zip(batch.column("id").to_pylist(), t.encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity, waste, room):
                    own = ids[4 * start : 4 * (start + length)]
                    piece = {"doc_id": doc, "start": start, "length": length, "ids_crc32": zlib.crc32(own), "doc_tokens": n, "room": int(room[length]), "worker": worker}
                    if with_ids:
                        piece["ids"] = own
                    out += bins.add(piece)
                    start += length
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        t.forget()
        yield pa.RecordBatch.from_pylist(bins.rest(), schema=schema)

    def again(stage: int):
        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by group and class; what a class of a group leaves goes on as it is."""
            bins, at = Bins(capacity, (stage << 20) + TaskContext.get().partitionId()), None
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    if (x["worker"], x["room"]) != at:
                        out += bins.rest()
                        bins.open.clear()
                        at = x["worker"], x["room"]
                    out += bins.add(x)
                yield pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_pylist(bins.rest(), schema=schema)

        return fill

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Longest first; each piece goes into the first open sequence with room for it, of the few that are open."""
        bins, open_, n_open = Bins(capacity, 1 << 30), [], 16
        for batch in batches:
            out = []
            for piece in batch.to_pylist():
                place = next((x for x in open_ if x[0] + piece["length"] <= capacity), None)
                if place is None:
                    if len(open_) == n_open:
                        fullest = max(open_, key=lambda x: x[0])
                        open_.remove(fullest)
                        out += bins.close(fullest[1])
                    open_.append(place := [0, []])
                place[0] += piece["length"]
                place[1].append(piece)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist([p for x in open_ for p in bins.close(x[1])], schema=schema)

    filled = [common.materialize(narrow, "pieces", through=first, columns=columns)]
    workers = (filled[0].agg(F.max("worker")).first()[0] or 0) + 1
    stage = 1
    while True:
        workers = -(-workers // FAN)
        left = filled[-1].filter("sequence_id IS NULL").withColumn("worker", (F.col("worker") / FAN).cast("int"))
        dealt = left.repartition(common.shuffle_partitions(spark), "worker", "room").sortWithinPartitions("worker", "room")
        filled.append(common.materialize(dealt, f"pieces-{stage}", through=again(stage), columns=columns))
        if workers == 1:
            break
        stage += 1
    order = [F.desc("length"), "doc_id", "start", "ids_crc32"]
    rest = filled[-1].filter("sequence_id IS NULL").coalesce(1).sortWithinPartitions(*order).mapInArrow(last, columns)
    return reduce(DataFrame.unionByName, [*(x.filter("sequence_id IS NOT NULL") for x in filled), rest]).drop("worker")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("room")
