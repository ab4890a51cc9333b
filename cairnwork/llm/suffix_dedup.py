"""Repeated passages by a sparse suffix array: a common-prefix-aware distributed merge sort.

A byte goes if it lies in a string of `LENGTH` bytes that also starts anywhere else. Exact, on the input as it is.

1. Anchors. Each start of a LENGTH-byte string has an anchor, the leftmost least hash of GRAM bytes among the next
   WINDOW positions. It depends on that string alone, so equal strings have their anchors at equal distances, and
   only suffixes at anchors (about two in WINDOW positions) need sorting. Anchors whose GRAM bytes occur once in the
   corpus are dropped by counting them.
2. Sorted runs. Each task sorts the suffixes (LENGTH bytes) at its anchors; equal ones are one entry with several
   places. The run is cut at splitters and front-coded: an entry is the length it shares with the one before, and the
   rest. A place is (document, position, starts it stands for, the bytes before it that those starts cover).
3. Merge. Each range of the sort order is merged by a loser tree that keeps, for every run, the length that its head
   shares with the last output. Heads are compared by these lengths; bytes are compared only on a tie and only
   beyond the known common prefix. For each suffix this gives the longest prefix it shares with any other (its
   neighbours in the suffix array; at a range's ends the splitter stands in, which can only lengthen it).
4. A string that starts d bytes before an anchor can repeat only if the anchor's suffix shares LENGTH - d bytes with
   another. The strings that the sort leaves stand next to each other in it, by anchors of one gram, and are compared
   by 64-bit hashes as the group goes by. Equal stretches are confirmed as they come and one is held. A group of more
   than GROUP different stretches, or one that a splitter cuts, is not held: its strings go to a table and are counted there in three steps that aggregate before they shuffle: whole
   stretches around an anchor; then, for the rest and one stretch of each repeated kind that shares a gram with it,
   blocks of BLOCK starts by the bytes they have in common; then single strings in the blocks that are left.
5. Confirmed starts are marked, and the marked bytes of every document removed.

Splitters come from a sample, by hash, of about SAMPLE suffixes for each range, which bears on balance alone. Lookups of
counts are plain sort-merge joins of narrow rows, which adaptive execution splits where a key is hot. Texts travel
compressed and only for documents with an anchor left. Steps are written to the shared folder.

Cases: a null text is empty. Rows are documents: a row given twice repeats itself and loses every byte that is in a
LENGTH-byte string. Texts shorter than LENGTH bytes stay whole. Very long texts are hashed alone; a run of one byte
makes an anchor of each position, but its equal suffixes are one entry. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

LENGTH = 400
WINDOW = 320
GRAM = LENGTH - WINDOW + 1
BLOCK = 16
SAMPLE = 32
GROUP = 4000
RUN_BYTES = 12 << 20
RANGE_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
_values = np.random.default_rng(9).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, up to n at least."""
    if not _powers or len(_powers[0]) < n:
        ones = (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64)))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x)))) for x in ones]
    return _powers


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix64((self.sums[end] - self.sums[start]) * self.back[start])


def find_anchors(data: np.ndarray, bounds: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, hash of the anchor's gram) for texts that stand one after another in data."""
    gram = length - window + 1
    last = len(data) - length
    if last < 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = h.of(at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    least = (grams & ~low) | at.astype(np.uint64)  # by half the hash; the leftmost of equal ones is the least
    have, need = 1, window
    while have < need:  # minima of twice as many positions each time
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least[: last + 1] & low).astype(np.int64)
    valid = np.ones(last + 1, bool)
    for end in bounds[1:-1].tolist():  # strings that would run into the next text
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    anchor = anchor[starts]
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    final = np.concatenate((first[1:], [len(anchor)])) - 1
    return anchor[first], starts[first], starts[final], grams[anchor[first]]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes need not be looked at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Place:
    """Where a suffix stands: its document, position, the distances of the nearest and farthest start, the bytes before."""

    __slots__ = ("at", "before", "doc", "far", "near")

    def __init__(self, doc: int, at: int, near: int, far: int, before: bytes):
        self.doc, self.at, self.near, self.far, self.before = doc, at, near, far, before


def front_code(entries: list[tuple[bytes, list[Place]]]) -> bytes:
    """A sorted stretch of a run: shared lengths, rests' lengths, numbers of places, the places, then all bytes."""
    import zstandard

    shared = [0, *(common_prefix(a[0], b[0]) for a, b in zip(entries, entries[1:]))]
    rests = [e[0][n:] for e, n in zip(entries, shared, strict=True)]
    places = [p for _, ps in entries for p in ps]
    head = np.array([len(entries), len(places)], "<u4").tobytes() + np.array([shared, [len(r) for r in rests]], "<u2").tobytes()
    head += np.array([len(ps) for _, ps in entries], "<u4").tobytes() + np.array([p.doc for p in places], "<i8").tobytes()
    head += np.array([p.at for p in places], "<i8").tobytes() + np.array([[p.near for p in places], [p.far for p in places]], "<u2").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(rests) + b"".join(p.before for p in places))


def front_decode(block: bytes) -> Iterator[tuple[int, bytes, list[Place]]]:
    """(shared with the one before, entry, places) in order, one at a time."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    at = 8
    columns = []
    for kind, size, count in (("<u2", 2, n), ("<u2", 2, n), ("<u4", 4, n), ("<i8", 8, m), ("<i8", 8, m), ("<u2", 2, m), ("<u2", 2, m)):
        columns.append(np.frombuffer(data, kind, count, at).tolist())
        at += size * count
    shared, sizes, counts, docs, positions, near, far = columns
    left, entry, k = at + sum(sizes), b"", 0
    for i in range(n):
        entry = entry[: shared[i]] + data[at : at + sizes[i]]
        at += sizes[i]
        places = []
        for j in range(k, k + counts[i]):
            places.append(Place(docs[j], positions[j], near[j], far[j], data[left : left + far[j]]))
            left += far[j]
        k += counts[i]
        yield shared[i], entry, places


def loser_tree(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge sorted front-coded runs: (shared with the last output, entry, places) in order.

    Every run's head has the length that it shares with the last output. Of two heads the one that shares more is the
    smaller; bytes are compared on a tie only, beyond that length, and the loser keeps the length found.
    """
    k = len(runs)
    shares, heads = [0] * k, [next(r, None) for r in runs]
    for i, head in enumerate(heads):
        if head is None:
            shares[i] = -1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = heads[a][1], heads[b][1]
        n = common_prefix(p, q, x)
        if p[n:] <= q[n:]:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    losers = [0] * k
    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        _, entry, places = heads[best]
        yield shares[best], entry, places
        heads[best] = next(runs[best], None)
        shares[best] = -1 if heads[best] is None else heads[best][0]
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def longest_shared(merged: Iterator[tuple[int, bytes, list[Place]]], low: bytes | None, high: bytes | None) -> Iterator[tuple[int, bytes, int, list[Place]]]:
    """(shared with the one before, entry, longest prefix shared with another suffix, places) of each distinct entry.

    low and high are the splitters around the range.
    """
    before: tuple[int, bytes, int, list[Place]] | None = None
    for n, entry, places in merged:
        if before is None:
            n = common_prefix(low, entry) if low is not None else 0
        elif n == len(entry) == len(before[1]):  # the same suffix in another run
            before = (before[0], entry, n, [*before[3], *places])
            continue
        else:
            yield before[0], before[1], max(before[2], n), before[3]
        before = (n, entry, len(entry) if len(places) > 1 else n, places)
    if before is not None:
        yield before[0], before[1], max(before[2], common_prefix(before[1], high) if high is not None else 0), before[3]


class Stretch:
    """The strings that start near to far bytes before an anchor, and their bytes."""

    __slots__ = ("at", "bytes", "doc", "far", "near", "whole")

    def __init__(self, entry: bytes, shared: int, p: Place, length: int):
        self.doc, self.at, self.far, self.near = p.doc, p.at, p.far, max(p.near, length - shared)
        self.whole = self.near == p.near  # the sort has ruled out none of its strings
        self.bytes = p.before + entry[: length - self.near]


class Group:
    """The stretches of one gram as they come: equal ones are confirmed at once, and one of each kind is held."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[bytes, int], list] = {}  # the first of its kind, and whether there were more

    def add(self, x: Stretch) -> Iterator[tuple[int, int, int]]:
        """(doc, first, last): ranges of starts that this one confirms."""
        kind = self.kinds.get((x.bytes, x.near))
        if kind is None:
            self.kinds[x.bytes, x.near] = [x, False]
            return
        if not kind[1]:
            kind[1] = True
            yield kind[0].doc, kind[0].at - x.far, kind[0].at - x.near
        yield x.doc, x.at - x.far, x.at - x.near

    def strings(self, length: int) -> Iterator[tuple[int, int, int]]:
        """Ranges of starts, of stretches alone in their kind, whose strings are in another kind as well."""
        one = [kind[0] for kind in self.kinds.values()]
        if len(one) < 2:
            return
        bounds = np.concatenate(([0], np.cumsum([len(x.bytes) for x in one])))
        near, far = np.array([x.near for x in one]), np.array([x.far for x in one])
        counts = far - near + 1
        which = np.repeat(np.arange(len(one)), counts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = bounds[which] + step
        h = Hashes(np.frombuffer(b"".join(x.bytes for x in one), np.uint8)).of(start, start + length)
        distance = far[which] - step
        keys = common.mix64(h + distance.astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.flatnonzero(np.concatenate(([True], (twice[1:] != twice[:-1]) | (which[1:] != which[:-1]), [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            x = one[which[a]]
            if twice[a] and not self.kinds[x.bytes, x.near][1]:
                yield x.doc, x.at - int(distance[a]), x.at - int(distance[b - 1])


def _rows(docs: DataFrame, id_col: str, text_col: str, with_others: bool = False) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *([F.struct(*others).alias("others")] if with_others and others else []),
    )
    return rows.select(F.xxhash64("id", "text").alias("doc"), *rows.columns)


def _anchors(rows: DataFrame, length: int, window: int) -> DataFrame:
    """(doc, place, gram): anchors, place packing position, farthest and nearest start as at << 24 | far << 12 | near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 18):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            at, first, last, gram = find_anchors(np.frombuffer(b"".join(texts), np.uint8), bounds, length, window)
            text = np.searchsorted(bounds, at, "right") - 1
            place = (at - bounds[text]) << 24 | (at - first) << 12 | (at - last)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(text)), pa.array(place), pa.array(gram.view(np.int64))], names=["doc", "place", "gram"])

    return rows.filter(F.octet_length("text") >= length).select("doc", "text").mapInArrow(run, "doc long, place long, gram long")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in two rows or more; counts aggregate before they are shuffled."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return rows.join(common.materialize(twice, "twice"), keys, "left_semi")


def _packed(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, packed, list): the compressed text of each document that has a list."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in common.slices(batches, "text"):
            packed = pa.array([packer.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), packed], names=["doc", "packed"])

    some = common.maybe_in(rows.select("doc", "text"), "doc", common.key_filter(lists, "doc"))
    return some.mapInArrow(pack, "doc long, packed binary").join(lists, "doc")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, pa.Array]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in common.slices(batches, "packed", 1 << 20):
        for doc, packed, listed in zip(batch.column("doc").to_pylist(), batch.column("packed"), batch.column("list"), strict=True):
            yield doc, unpack.decompress(packed.as_py()), listed.values


def _splitters(texts: DataFrame, length: int, gram: int, share: float) -> list[bytes]:
    """Splitters of the sort order: every SAMPLE-th of the suffixes that a share of all hash values admits.

    The sample is sorted in Spark, equal suffixes being one, and the driver gets the splitters alone. One stands before
    a whole group of one gram, but inside if its neighbour does too: that group fills a range.
    """
    most = np.uint64(min(share, 1.0) * 0xFFFFFFFFFFFFF000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()
        for _, data, places in _unpacked(batches):
            at = places.to_numpy() >> 24
            h = common.mix64(Hashes(np.frombuffer(data, np.uint8)).of(at, np.minimum(at + length, len(data))))
            held.update(data[p : p + length] for p in at[h <= most].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.binary())], names=["suffix"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            out = []
            for x in batch.column("suffix").to_pylist():
                if x != last:
                    last, n = x, n + 1
                    if n % SAMPLE == 0:
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["suffix"])

    sample = texts.mapInArrow(run, "suffix binary").orderBy("suffix").mapInArrow(every, "suffix binary")
    cuts = sorted(bytes(r["suffix"]) for r in sample.collect())
    near = [{x[:gram] for x in cuts[max(0, i - 1) : i] + cuts[i + 1 : i + 2]} for i in range(len(cuts))]
    return [s if s[:gram] in others else s[:gram] for s, others in zip(cuts, near, strict=True)]


def _runs(texts: DataFrame, length: int, splitters: list[bytes]) -> DataFrame:
    """(range, block): sorted runs of distinct suffixes, front-coded, cut at the splitters."""
    cuts = texts.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[Place]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            order = sorted(held)
            ends = [bisect_left(order, s) for s in cuts.value] + [len(order)]
            names, blocks, start = [], [], 0
            for i, end in enumerate(ends):
                if end > start:
                    names.append(i)
                    blocks.append(front_code([(s, held[s]) for s in order[start:end]]))
                    start = end
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["range", "block"])

        for doc, data, places in _unpacked(batches):
            for x in places.to_pylist():
                at, far, near = x >> 24, x >> 12 & 4095, x & 4095
                place = Place(doc, at, near, far, data[at - far : at])
                suffix = data[at : at + length]
                same = held.get(suffix)
                if same is None:
                    held[suffix] = [place]
                    size += len(suffix) + 100
                else:
                    same.append(place)
                size += far + 150
            if size > RUN_BYTES:
                yield out()
                size = 0
        yield out()

    return texts.mapInArrow(run, "range int, block binary")


def _merged(runs: DataFrame, splitters: list[bytes], length: int, gram: int, most: int) -> DataFrame:
    """Rows of two kinds: (doc, first, last) of confirmed starts, and, for groups not held, their stretches."""
    cuts = runs.sparkSession.sparkContext.broadcast(splitters)
    kinds = [("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("gram", pa.int64()), ("at", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("whole", pa.bool_()), ("bytes", pa.binary())]

    def merge(number: int, blocks: list[bytes]) -> Iterator[dict]:
        low = cuts.value[number - 1] if number else None
        high = cuts.value[number] if number < len(cuts.value) else None
        group = Group()
        name, kept_back = 0, False  # of the group; whether its strings go to the table

        def let_go() -> Iterator[dict]:
            """One stretch of each kind, and a second where there were more, which makes its strings count as repeated."""
            for x, more in group.kinds.values():
                row = {"doc": x.doc, "gram": name, "at": x.at, "near": x.near, "far": x.far, "whole": x.whole, "bytes": x.bytes}
                yield row
                if more:
                    yield row | {"at": -1 - x.at}
            group.kinds.clear()

        def close() -> Iterator[dict]:
            if kept_back:
                yield from let_go()
            else:
                for doc, first, last in group.strings(length):
                    yield {"doc": doc, "first": first, "last": last}
            group.kinds.clear()

        entry = None
        for n, entry, shared, places in longest_shared(loser_tree([front_decode(b) for b in blocks]), low, high):
            if n < gram or not name:
                yield from close()
                name = int.from_bytes(hashlib.blake2b(entry[:gram], digest_size=8).digest(), "big", signed=True) or 1
                kept_back = n >= gram  # the splitter below cuts it
            if shared >= gram:
                for p in places:
                    x = Stretch(entry, shared, p, length)
                    if x.near <= x.far:
                        for doc, first, last in group.add(x):
                            yield {"doc": doc, "first": first, "last": last}
                if len(group.kinds) > most:
                    kept_back = True
                    yield from let_go()
        if entry is not None and high is not None and common_prefix(entry, high) >= gram:
            kept_back = True
        yield from close()

    def batched(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in found:
            rows.append(r)
            size += 100 + len(r.get("bytes", b""))
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blocks = None, []
        for batch in batches:
            for i, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if i != number and blocks:
                    yield from batched(merge(number, blocks))
                    blocks = []
                    common.trim()
                number = i
                blocks.append(block)
        if blocks:
            yield from batched(merge(number, blocks))
        common.trim()

    dealt = runs.repartition(len(splitters) + 1, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "doc long, first long, last long, gram long, at long, near int, far int, whole boolean, bytes binary")


def _pieces(stretches: DataFrame, length: int, step: int) -> DataFrame:
    """(doc, at, d, key): for each block of `step` distances d, d+1, ... the bytes that all its strings have in common.

    With step 1 these are the strings themselves. near and far are distances from the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "bytes", 1 << 20):
            bits = batch.column("bytes").to_pylist()
            near, far = (batch.column(c).to_numpy().astype(np.int64) for c in ("near", "far"))
            bounds = np.concatenate(([0], np.cumsum([len(b) for b in bits])))
            h = Hashes(np.frombuffer(b"".join(bits), np.uint8))
            lowest, blocks = near // step, far // step - near // step + 1
            which = np.repeat(np.arange(len(bits)), blocks)
            d = step * (lowest[which] + np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            anchor = bounds[which] + far[which]
            start, end = anchor - d, anchor - d + length - step + 1
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("at").take(take), pa.array(d.astype(np.int32)), pa.array(h.of(start, end).view(np.int64))],
                names=["doc", "at", "d", "key"],
            )

    return stretches.select("doc", "at", "near", "far", "bytes").mapInArrow(run, "doc long, at long, d int, key long")


def _counted(stretches: DataFrame, length: int) -> DataFrame:
    """(doc, first, last) of the starts in a table of stretches whose strings occur twice in it."""
    step = min(BLOCK, length // 2)
    hashed = stretches.withColumn("key", F.xxhash64("bytes"))
    whole = common.materialize(repeated(hashed.filter("whole"), ["gram", "key", "near", "far"]), "whole")
    rest = hashed.join(whole.select("doc", "at").distinct(), ["doc", "at"], "left_anti")
    # strings of the rest may also equal some in a whole stretch: one of each kind stands in for those
    kinds = whole.groupBy("gram", "key", "near", "far").agg(F.min(F.struct("doc", "at")).alias("one")).select("gram", "one.*")
    kinds = kinds.join(rest.select("gram").distinct(), "gram", "left_semi").select("doc", "at")
    columns = ["doc", "at", "near", "far", "bytes"]
    some = common.materialize(rest.select(*columns).unionByName(whole.join(kinds, ["doc", "at"], "left_semi").select(*columns)), "stretches")
    blocks = repeated(_pieces(some, length, step), ["key", "d"]).select("doc", "at", "d").distinct()
    near, far = F.greatest("near", "d"), F.least("far", F.col("d") + step - 1)
    cut = F.substring("bytes", (F.col("far") - far + 1).cast("int"), (far - near + length).cast("int"))
    narrowed = some.join(blocks, ["doc", "at"]).select("doc", "at", near.alias("near"), far.alias("far"), cut.alias("bytes"))
    single = repeated(_pieces(narrowed, length, 1), ["key", "d"])
    single = single.select("doc", (F.col("at") - F.col("d")).alias("first"), (F.col("at") - F.col("d")).alias("last"), "at")
    found = whole.select("doc", (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last"), "at")
    return found.unionByName(single).filter("at >= 0").drop("at")


def repeated_starts(rows: DataFrame, length: int = LENGTH, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc, first, last): ranges of starts of strings that occur elsewhere, of rows (doc, text)."""
    anchors = _anchors(rows, length, window)
    lists = repeated(anchors, ["gram"]).groupBy("doc").agg(F.collect_list("place").alias("list"))
    lists = common.materialize(lists, "anchors")
    texts = common.materialize(_packed(rows, lists), "texts")
    gram = length - window + 1
    splitters = _splitters(texts, length, gram, SAMPLE * (length + window // 2) / RANGE_BYTES)
    merged = common.materialize(_merged(_runs(texts, length, splitters), splitters, length, gram, group), "merged")
    found = merged.filter("first IS NOT NULL").select("doc", "first", "last")
    return found.unionByName(_counted(merged.filter("first IS NULL"), length))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, window: int | None = None, group: int = GROUP, with_text: bool = False,
) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans [(from, to) in bytes], and with_text kept_text.

    kept_text is what remains; bytes of characters that a cut went through are left out of it. With it come the input's
    other columns, as the fields of one column `others`. Rows without a marked start (by a key filter) are not shuffled.
    """
    rows = _rows(docs, id_col, text_col, with_text)
    marks = repeated_starts(rows, length, window or max(1, length * 4 // 5), group)
    lists = common.materialize(marks.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("list")), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, ranges in _unpacked(batches):
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, ranges.field("first").to_numpy(), 1)
            np.add.at(depth, ranges.field("last").to_numpy() + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            yield pa.RecordBatch.from_pylist([{
                "doc": doc, "n_removed": int(gone.sum()), "n_spans": len(edge) // 2, "kept": hashlib.sha256(kept).hexdigest(),
                "spans": [{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()], "kept_text": kept.decode(errors="ignore") if with_text else None,
            }], schema=pa.schema([
                ("doc", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()),
                ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept_text", pa.string()),
            ]))

    texts = _packed(rows.select("doc", "text"), lists)
    changed = texts.mapInArrow(
        run, "doc long, n_removed long, n_spans long, kept string, spans array<struct<from: long, to: long>>, kept_text string",
    ).dropDuplicates(["doc"])
    whole = rows.select("doc", "id", F.octet_length("text").cast("long").alias("n_bytes"), "text", *(["others"] if "others" in rows.columns else []))
    marked = common.flagged(whole, "doc", common.key_filter(lists, "doc"), "maybe")
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    touched = marked.filter("maybe").withColumn("sha", sha).drop("maybe", *([] if with_text else ["text"])).join(changed, "doc", "left")
    out = touched.unionByName(marked.filter("NOT maybe").withColumn("sha", sha).drop("maybe"), allowMissingColumns=True)
    zero: Callable[[str], object] = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)")).alias("spans"),
        *([F.coalesce("kept_text", "text").alias("kept_text"), *(["others"] if "others" in rows.columns else [])] if with_text else []),
    )


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=LENGTH, with_text=True).withColumnRenamed("kept_text", "text")
