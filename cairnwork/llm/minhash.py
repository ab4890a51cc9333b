"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Shingles are hashed in numpy; each document gets the size and a 64-bit hash of its whole set and a signature of
   `TREES * STEP` minima. Documents with equal sets form one class, found by aggregation; only classes go on.
2. The forest: tree t sorts the signatures in an order of its own, which begins at minimum t * STEP and goes round.
   In each sorted order the classes that share their first STEP minima form a region. Regions of one are dropped.
   The order goes on for DEPTH minima, so the depth at which neighbours agree adapts to the region: the denser it is,
   the more minima next neighbours share.
3. First candidates are next neighbours, by longest common prefix, in every tree's regions: one a class and tree.
   Their links are confirmed on the full sets, and components taken.
4. What these leave is settled in full. In each region that still holds several components, every class outside the
   largest is held against every class of another one by sketches, the last four bits of each minimum; a pair whose
   sketches agree in fewer places than a similarity at the threshold would give, less five standard errors, is
   dropped. The pairs left are never listed: a task reports which classes have one, and joins the components that have
   one between them, of which it reports a forest. The connected components so joined are clusters.
5. In each cluster every class outside its largest component is held against every reported class of another one, on
   the full sets. A part of these classes, bounded in bytes, is held as an inverted index; a part of all streams past, and
   each gets its intersections with all of the part at once. A task reports the links that join components, a forest
   too. So no pair of a region goes untried, and rows written never grow with the square of a group; the comparisons
   do so only where many classes of one region are truly apart.
6. Components of confirmed links are taken by star contraction; every row gets its class's component.

Every result of a step is written to the shared folder. No step collects rows to the driver. What can be lost are
links between classes that share no region in any tree (about 5 in 10^8 pairs at a similarity of 0.8) or whose
sketches differ by five standard errors (3 in 10^7), unless other links join the same components.

Cases: words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. With fewer than WORDS words the whole sequence is the
one shingle; a null text or one without words has an empty set (n_shingles 0), is linked with nothing and is its own
component. Repeated rows have equal sets and so are linked; all rows with the component's id are `kept`. A null id
never is a component's smallest unless all are null. Very long texts are hashed in pieces. An empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common
from cairnwork.llm.components import components

TREES, STEP, DEPTH = 32, 4, 12
SIZE = TREES * STEP
WIDE = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
_factors = np.random.default_rng(20).integers(0, 1 << 63, SIZE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        import xxhash

        codes = [xxhash.xxh64_intdigest(w) for w in text.lower().split()]
        h = np.array(codes, np.uint64)
    else:  # Spark gives all its workers one seed
        split = text.lower().split()
        h = np.fromiter(map(hash, split), np.int64, len(split)).view(np.uint64)
    n = min(words, len(h))
    if not n:
        return h
    h = common.mix64(h)
    rolled = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        rolled = rolled * BASE + h[i : len(h) - n + 1 + i]
    return np.unique(common.mix64(rolled + np.uint64(n)))


def signature(hashes: np.ndarray, piece: int = 8192) -> np.ndarray:
    out = np.full(SIZE, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), piece):
        np.minimum(out, (hashes[None, i : i + piece] * _factors[:, None] >> np.uint64(32)).min(axis=1), out=out)
    return out.astype("<u4")


def set_hash(hashes: np.ndarray) -> int:
    """One number for a set, whatever the order."""
    both = np.array([hashes.sum(), np.bitwise_xor.reduce(hashes) if len(hashes) else 0, len(hashes)], np.uint64)
    mixed = common.mix64(both)
    return int(common.mix64(mixed[:1] * BASE + mixed[1:2] * np.uint64(3) + mixed[2:])[0].astype(np.int64))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            n, ids, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles((text or "").encode(), words)
                n.append(len(hashes))
                ids.append(set_hash(hashes))
                sigs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "text_key", "n", "cid", "sig"])

    return docs.mapInArrow(run, f"id {kind}, text_key long, n long, cid long, sig binary")


def _orders(classes: DataFrame) -> DataFrame:
    """Each class at its place in every tree's order: (region, key, tree, cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, SIZE)
                for t in range(TREES):
                    own = sig[:, (t * STEP + np.arange(DEPTH)) % SIZE]
                    region = np.full(len(own), t + 1, np.uint64)
                    for i in range(STEP):
                        region = common.mix64(region * BASE + own[:, i])
                    deeper = np.ascontiguousarray((own[:, STEP:] >> 16).astype(">u2")).view(np.uint8).reshape(len(own), -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(region.view(np.int64)), pa.array([x.tobytes() for x in deeper], pa.binary()), pa.array(np.full(len(own), t, np.int32)), part.column("cid")],
                        names=["region", "key", "tree", "cid"],
                    )

    return classes.select("cid", "sig").mapInArrow(run, "region long, key binary, tree int, cid long")


def _regions(orders: DataFrame) -> DataFrame:
    """Rows of regions with two classes or more: each row next to one of its own region in the sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far
        kept = False
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column("region").to_numpy()
            same = region[1:] == region[:-1]
            keep = np.zeros(len(region), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                joins = held.column("region")[0].as_py() == region[0]
                keep[0] |= joins
                if kept or joins:
                    yield held
            yield batch.slice(0, len(region) - 1).filter(pa.array(keep[:-1]))
            held, kept = batch.slice(len(region) - 1), bool(keep[-1])
        if held is not None and kept:
            yield held

    parts = common.shuffle_partitions(orders.sparkSession)
    return orders.repartition(parts, "region").sortWithinPartitions("region", "key", "cid").mapInArrow(run, "region long, key binary, tree int, cid long")


def _sketches(classes: DataFrame) -> DataFrame:
    """(cid, sketch): the last four bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = (np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, SIZE) & 15).astype(np.uint8)
            packed = low[:, ::2] << 4 | low[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([x.tobytes() for x in packed], pa.binary())], names=["cid", "sketch"])

    return classes.select("cid", "sig").mapInArrow(run, "cid long, sketch binary")


_agree = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)  # halves of a byte that are equal, by xor


def _least_agreeing(threshold: float) -> float:
    """In how many places the sketches of two sets at the threshold agree, less five standard errors."""
    expected = threshold + (1 - threshold) / 16
    return (expected - 5 * (expected * (1 - expected) / SIZE) ** 0.5) * SIZE


def likely(sketches: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows the sketches do not rule out."""
    return _agree[sketches[pairs[:, 0]] ^ sketches[pairs[:, 1]]].sum(axis=1) >= _least_agreeing(threshold)


def _neighbours(places: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a < b) of next neighbours in each region of rows (region, key, cid, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(batch.num_rows - 1)
            region, cid = rows.column("region").to_numpy(), rows.column("cid").to_numpy()
            at = np.flatnonzero(region[1:] == region[:-1])
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            at = at[likely(sketches, np.stack([at, at + 1], axis=1), threshold)]
            x, y = cid[at], cid[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    parts = common.shuffle_partitions(places.sparkSession)
    dealt = places.select("region", "key", "cid", "sketch").repartition(parts, "region").sortWithinPartitions("region", "key", "cid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _outside(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows of groups with several components, with outside (not of the group's largest component), rest and whole (the sizes of all outside, and of all)."""
    counts = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    sizes = counts.groupBy(group).agg(F.max(F.struct("n", "size", "label")).alias("top"), F.sum("size").alias("whole"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    sizes = sizes.select(group, F.col("top.label").alias("largest"), (F.col("whole") - F.col("top.size")).alias("rest"), "whole")
    return rows.join(sizes, group).withColumn("outside", F.col("label") != F.col("largest")).drop("largest")


def _against(rows: DataFrame, group: str, part: int, columns: list[str]) -> DataFrame:
    """Rows (group, part, *columns, first), sorted: in each part, of those outside one share (`first`), then one share of all the group.

    Shares of those outside are of about size `part`, of all WIDE times that, and each meets each in some part: what
    one task reads is bounded, however large the group is.
    """
    shares, wide = F.ceil(F.col("rest") / F.lit(part)), F.ceil(F.col("whole") / F.lit(WIDE * part))
    share = lambda n, c: F.pmod(F.xxhash64(F.lit(c), "cid"), n)
    part_of = lambda own, other: (own * wide + other).cast("long").alias("part")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    first = rows.filter("outside").select(group, "rest", "whole", *columns, each(wide).alias("at")).select(group, part_of(share(shares, "first"), F.col("at")), *columns, F.lit(True).alias("first"))
    every = rows.select(group, "rest", "whole", *columns, each(shares).alias("at")).select(group, part_of(F.col("at"), share(wide, "all")), *columns, F.lit(False).alias("first"))
    dealt = first.unionByName(every).repartition(common.shuffle_partitions(rows.sparkSession), group, "part")
    return dealt.sortWithinPartitions(group, "part", F.desc("first"))


class Roots:
    """Union-find over labels; join() says whether two were apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _spans(batch: pa.RecordBatch, group: str) -> Iterator[tuple[tuple, bool, int, int]]:
    """((group, part), first, from, to) of stretches of equal ones."""
    names, part = batch.column(group).to_numpy(), batch.column("part").to_numpy()
    first = batch.column("first").to_numpy(zero_copy_only=False)
    new = (names[1:] != names[:-1]) | (part[1:] != part[:-1]) | (first[1:] != first[:-1])
    bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        yield (int(names[i]), int(part[i])), bool(first[i]), i, j


def _alike(mixed: DataFrame, threshold: float, part: int = 2048) -> DataFrame:
    """Of pairs of different components in a region that the sketches do not rule out: (a, b) a forest of the components
    that they join, and (cid) the classes that are in one. mixed: (region, cid, label, sketch, outside, rest)."""
    least = _least_agreeing(threshold)
    ones = np.uint64(0x1111111111111111)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts, roots, seen = None, [], Roots(), np.zeros(0, bool)

        def out(a: list[int], b: list[int], cids: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(len(cids), pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(cids), pa.int64())]), pa.concat_arrays([none, pa.array(cids, pa.int64())])],
                names=["a", "b", "cid"],
            )

        def rest() -> Iterator[pa.RecordBatch]:
            if seen.any():
                yield out([], [], firsts[0][0][seen])

        for batch in batches:
            if not batch.num_rows:
                continue
            cid, label = batch.column("cid").to_numpy(), batch.column("label").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            for where, first, i, j in _spans(batch, "region"):
                if where != at:
                    yield from rest()
                    at, firsts, roots, seen = where, [], Roots(), np.zeros(0, bool)
                if first:
                    firsts.append((cid[i:j], label[i:j], sketch[i:j]))
                    continue
                if not firsts:  # a share that no class fell to
                    continue
                if not len(seen):
                    firsts = [tuple(map(np.concatenate, zip(*firsts, strict=True)))]
                    seen = np.zeros(len(firsts[0][0]), bool)
                _, own, left = firsts[0]
                for k in range(i, j, 128):
                    to = slice(k, min(j, k + 128))
                    unlike = np.zeros((len(left), to.stop - k), np.int16)
                    for w in range(left.shape[1]):
                        x = left[:, w, None] ^ sketch[None, to, w]
                        x |= x >> np.uint64(2)
                        x |= x >> np.uint64(1)
                        unlike += np.bitwise_count(x & ones)
                    hit = (SIZE - unlike >= least) & (own[:, None] != label[None, to])
                    if not hit.any():
                        continue
                    seen |= hit.any(axis=1)
                    joined = []
                    for q in np.flatnonzero(hit.any(axis=0)).tolist():
                        y = int(label[k + q])
                        joined += [(int(x), y) for x in np.unique(own[hit[:, q]]).tolist() if roots.join(x, y)]
                    yield out([x for x, _ in joined], [y for _, y in joined], cid[to][hit.any(axis=0)])
        yield from rest()

    return _against(mixed, "region", part, ["cid", "label", "sketch"]).mapInArrow(run, "a long, b long, cid long")


class Index:
    """Sets of hashes, inverted: how much each has in common with another set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.starts, self.counts = np.unique(tokens[order], return_index=True, return_counts=True)

    def alike(self, x: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 * intersection >= percent * union with x."""
        at = np.searchsorted(self.tokens, x)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == x]
        if 100 * len(at) < percent * len(x):  # too little of x is in any of them
            return np.zeros(0, np.int64)
        counts = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(x) - both))


def _joining(rows: DataFrame, percent: int, part: int = 4 << 20) -> DataFrame:
    """Confirmed links (a, b) of classes of different components that join these. rows: (cluster, cid, label, hashes, outside, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts, index, roots = None, [], None, Roots()
        for batch in common.slices(batches, "hashes", 1 << 20):
            cid, label = batch.column("cid").to_pylist(), batch.column("label").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            a, b = [], []
            for where, first, i, j in _spans(batch, "cluster"):
                if where != at:
                    at, firsts, index, roots = where, [], None, Roots()
                if first:
                    firsts += zip(cid[i:j], label[i:j], sets[i:j], strict=True)
                    continue
                if not firsts:  # a share that no class fell to
                    continue
                if index is None:
                    index = Index([x[2] for x in firsts])
                    firsts = [x[:2] for x in firsts]
                for k in range(i, j):
                    for q in index.alike(sets[k], percent).tolist():
                        if roots.join(label[k], firsts[q][1]):
                            a.append(min(cid[k], firsts[q][0]))
                            b.append(max(cid[k], firsts[q][0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _against(rows, "cluster", part, ["cid", "label", "hashes"]).mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, hashes) of the given classes (cid, id), hashed anew from the row that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            sets = [shingles((t or "").encode(), words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "hashes"])

    some = common.maybe_in(docs, "id", common.key_filter(classes, "id"))
    hashed = some.select("text").mapInArrow(run, "cid long, hashes binary")
    return hashed.join(classes.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "x", 1 << 20):
            keep = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    x, y = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept, text_key (xxhash64 of the text, null as empty)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keyed = rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    signed = common.materialize(_signed(keyed, words), "minhash")
    classes = common.materialize(
        signed.filter("n > 0").groupBy("cid").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig")), "classes",
    )
    regions = common.materialize(_regions(_orders(classes)), "regions")
    active = common.materialize(classes.join(regions.select("cid").distinct(), "cid", "left_semi"), "active")
    sets = common.materialize(_sets(rows, active.select("cid", "id"), words), "sets")
    places = common.materialize(regions.join(_sketches(active), "cid"), "places")

    def labelled(of: DataFrame, labels: DataFrame) -> DataFrame:
        return of.join(labels, of["cid"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "cid"))

    links = common.materialize(_confirmed(common.materialize(_neighbours(places, percent / 100), "pairs"), sets, percent), "confirmed")
    labels = components(links)
    mixed = common.materialize(_outside(labelled(places.select("region", "cid", "sketch"), labels), "region", F.lit(1)), "mixed")
    alike = common.materialize(_alike(mixed, percent / 100), "alike")
    clusters = components(alike.select("a", "b")).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    left = labelled(alike.select("cid").filter("cid IS NOT NULL").distinct(), labels).join(clusters, "label").join(sets, "cid")
    left = common.materialize(_outside(left, "cluster", F.octet_length("hashes")), "left")
    labels = components(links.unionByName(common.materialize(_joining(left, percent), "joining")))
    joined = classes.join(labels, classes["cid"] == labels["node"], "left").select("cid", "id", "size", F.coalesce("label", "cid").alias("label"), F.col("label").isNotNull().alias("linked"))
    named = joined.join(joined.filter("linked").groupBy("label").agg(F.min("id").alias("least")), "label", "left")
    named = named.filter("linked OR size > 1").select("cid", F.coalesce("least", "id").alias("component_id"))
    out = common.salted_lookup(signed.select("id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid")), named, "cid", "id")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_key")


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4, percent=80).drop("text_key")
