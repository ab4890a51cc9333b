"""Language identification by language-bitmask n-gram filters (bit-sliced Bloom filters).

Learning: of each language's labelled rows, about `sample` are taken by a hash of their id (a documented bound: the
model's size and the time to fit it do not grow with the table). The n-grams (3 to 5 bytes of lower-cased words, with
their borders) that occur in at least `least` of a language's sampled documents, at most `grams` of the most frequent
for each language, go into that language's Bloom filter. The filters of all languages share their positions: slot i
holds a bitmask with the bit of every language whose filter has bit i set, so that HASHES lookups, joined by AND, give
all languages that contain an n-gram. The table has 2^SLOT_BITS slots, whatever the number of rows, and as many words a
slot as the languages need at 64 a word; it is broadcast. `grams` and `least` bound the filters' fill: rarer n-grams
would add little to the counts and more chance hits. tests/llm/test_langid.py holds held-out accuracy.

Deciding: n-grams of the whole text are looked up; per language, the bits are counted. With a language's fill f, an
n-gram that it lacks is found by chance with probability f^HASHES, which is taken out of the count. The corrected
share is set against the share that the language's own sampled documents reach. The highest wins, ties going to the
name that sorts first.

Cases: `und` with score 0 if the text is null or has no letter (a character of Unicode's categories L), or if no
language could be learned. Rows are
independent; repeated rows give repeated results, an empty table none. The whole of a very long text is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

ORDERS = (3, 4, 5)
HASHES = 3
SLOT_BITS = 21
SCHEMA = "lang_pred string, score double, coverage double"
_letter = re.compile(r"[^\W\d_]")  # letters, and numbers such as ½ that are not decimal digits
_to_space = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _bytes(text: str) -> bytes:
    """Lower-case words, one space between and around them."""
    return b" " + b" ".join(text.lower().encode().translate(_to_space).split()) + b" "


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (codes of the n-grams of all texts, where each text's begin). A code is one to one within 7 bytes."""
    data = [_bytes(t) for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    code = flat
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | flat[n - 1 :] if len(code) else code
        if n in ORDERS:
            within = np.ones(len(code), bool)
            for k in range(1, n):  # windows that run into the next text
                ends = starts[1:] - k
                within[ends[(ends >= 0) & (ends < len(code))]] = False
            kept = np.zeros(len(code) + 1, np.int64)
            np.cumsum(within, out=kept[1:])
            yield code[within] | np.uint64(n << 56), kept[np.minimum(starts, len(code))]


def has_letter(text: str) -> bool:
    found = _letter.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def slots(codes: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    mixed = common.mix64(codes)
    low = np.uint64((1 << slot_bits) - 1)
    return [((mixed >> np.uint64(21 * i)) & low).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # bitmasks of up to 64 languages each in every slot
    chance: np.ndarray  # of each language: how likely an n-gram that it lacks is found
    usual: np.ndarray  # of each language: the corrected share that its own documents reach
    slot_bits: int

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for codes, bounds in ngrams(texts):
            total += np.diff(bounds)
            if not len(codes):
                continue
            at = slots(codes, self.slot_bits)
            counted = np.zeros(len(codes) + 1, np.int64)
            for i in range(len(self.languages)):
                if i % 64 == 0:
                    table = self.tables[i // 64]
                    found = table[at[0]]
                    for more in at[1:]:
                        found &= table[more]
                np.cumsum((found >> table.dtype.type(i % 64)) & table.dtype.type(1), out=counted[1:])
                hits[:, i] += counted[bounds[1:]] - counted[bounds[:-1]]
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.chance) / (1 - self.chance), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, corrected share) of each text."""
        langs, score, coverage = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        which = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        if which:
            share = self.shares([texts[i] for i in which])
            relative = share / self.usual
            best = relative.argmax(axis=1)
            total = relative.sum(axis=1)
            for k, i in enumerate(which):
                langs[i] = self.languages[best[k]]
                score[i] = relative[k, best[k]] / total[k] if total[k] else 0.0
                coverage[i] = share[k, best[k]]
        return langs, np.clip(score, 0, 1), coverage


def _sampled(labelled: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The languages, and about `sample` of each one's rows, by a hash of their id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], labelled
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample / n))])
    unit = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / float(1 << 30)
    return sorted(counts), labelled.filter(unit < share[F.col("lang")])


def fit(labelled: DataFrame, *, sample: int = 1500, grams: int = 60_000, least: float = 0.004, slot_bits: int = SLOT_BITS) -> Model:
    """Learn from rows (id, text, lang)."""
    languages, rows = _sampled(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), sample)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each language: in how many of its texts an n-gram occurs; a row -1 counts the texts."""
        for batch in common.slices(batches, "text", 1 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                codes = [[] for _ in own]
                for code, bounds in ngrams(own):
                    for i in range(len(own)):
                        codes[i].append(np.unique(code[bounds[i] : bounds[i + 1]]))
                gram, n = np.unique(np.concatenate([c for cs in codes for c in cs]), return_counts=True)
                gram, n = np.append(gram.view(np.int64), -1), np.append(n, len(own))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(frequencies, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = common.materialize(counted, "langid-grams")
    docs_of = {r["lang"]: r["n"] for r in counted.filter("gram = -1").collect()}
    languages = [x for x in languages if docs_of.get(x)]
    width = np.uint8 if len(languages) <= 8 else np.uint32 if len(languages) <= 32 else np.uint64
    tables = [np.zeros(1 << slot_bits, width) for _ in range(0, len(languages), 64)]
    found = {}
    for i, lang in enumerate(languages):
        enough = max(2, least * docs_of[lang]) if docs_of[lang] > 20 else 1
        top = counted.filter((F.col("lang") == lang) & (F.col("gram") != -1) & (F.col("n") >= enough)).orderBy(F.desc("n"), "gram").limit(grams)
        found[lang] = top.select("gram").toArrow().column("gram").to_numpy().view(np.uint64)
        for at in slots(found[lang], slot_bits):
            tables[i // 64][at] |= width(1 << i % 64)
    fill = np.array([np.mean((tables[i // 64] >> width(i % 64)) & width(1)) for i in range(len(languages))])
    model = Model(languages, tables, fill**HASHES, np.ones(len(languages)), slot_bits)
    for i, lang in enumerate(languages):  # what its own documents reach, from a few of them
        own = [r["text"] for r in rows.filter(F.col("lang") == lang).orderBy(F.xxhash64("id")).select("text").limit(50).collect()]
        model.usual[i] = max(0.05, float(np.median(model.shares(own)[:, i]))) if own else 1.0
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and coverage after its own columns (which those names replace)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "coverage")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col, 1 << 20):
            langs, score, coverage = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(score), pa.array(coverage)], names=[*batch.schema.names, *new])

    return own.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, **options) -> Model:
    """Learn from the documents that are not held out."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang").filter(~held_out(F.col("id")))
    return fit(rows, **options)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, fit_documents(docs)).drop("text")
