"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

A document's words are the runs of [^\\x20\\x09-\\x0D]. For every n in NGRAMS, a rolling hash of each window of n
words marks the words that lie in a window found twice or more; the share of the document's word characters inside
them is its coverage at n. Likewise for lines. A document whose coverage exceeds a limit fails.

All documents of a batch are hashed together: windows that would cross a document's end are left out, and the
document's number is mixed into each hash, so that one sort finds the repeats within every document.

Cases: a null text has no words (n_words 0, base_failed true). Rows are independent: repeated rows give repeated
results, an empty table none. Very long texts are a batch of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: The most of a document's word characters that may lie inside repeated n-grams of n words.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.25, 9: 0.24, 10: 0.23}
#: The most of a document's word characters that may lie in lines that repeat an earlier line.
LINE_LIMIT = 0.30
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, coverage array<double>, line_coverage double"
)

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_white = np.zeros(256, bool)
_white[[0x20, *range(9, 14)]] = True


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between successive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    by = keys[order]
    same = by[1:] == by[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def window_hashes(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of words[i:i+n] for each i) for n = 1, 2, ... longest; each from the one before."""
    base = np.uint64(0x9E3779B97F4A7C15)
    rolled = words.copy()
    yield 1, rolled
    for n in range(2, longest + 1):
        rolled = rolled[:-1] * base + words[n - 1 :] if len(rolled) > 1 else rolled[:0]
        yield n, rolled


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and coverages of each text, in UTF-8."""
    n_docs = len(texts)
    words_of = [t.split() for t in texts]  # bytes.split() parts at [\x20\x09-\x0D] exactly
    counts = np.fromiter(map(len, words_of), np.int64, n_docs)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    flat = [w for ws in words_of for w in ws]
    hashed = common.mix64(np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64))
    doc_of = np.repeat(np.arange(n_docs), counts)

    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, n_docs)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    points = (data & 0xC0) != 0x80  # first bytes of code points
    n_symbols = _per_doc(_symbol[data], ends)
    starts = points & ~_white[data]
    word_chars = _per_doc(starts, ends)

    # code points of every word: those between the word's first byte and the next word's
    inside = ~_white[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends[:-1][sizes > 0]] |= inside[ends[:-1][sizes > 0]]
    at = np.flatnonzero(first)
    chars = np.add.reduceat(starts.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)

    salt = common.mix64(np.arange(n_docs).astype(np.uint64) + np.uint64(1))[doc_of] if len(flat) else np.zeros(0, np.uint64)
    coverage = np.zeros((n_docs, len(NGRAM_LIMITS)))
    n_repeat = np.zeros(n_docs, np.int64)
    lengths = sorted(NGRAM_LIMITS)
    whole = np.maximum(word_chars, 1)
    for n, rolled in window_hashes(hashed, max(*lengths, WINDOW)):
        if n not in NGRAM_LIMITS and n != WINDOW or not len(rolled):
            continue
        within = np.flatnonzero(doc_of[: len(rolled)] == doc_of[n - 1 :])
        twice = within[_repeated(common.mix64(rolled[within]) ^ salt[within])]
        depth = np.bincount(twice, minlength=len(flat) + 1) - np.bincount(twice + n, minlength=len(flat) + 1)
        covered = np.cumsum(depth[:-1]) > 0
        if n == WINDOW:
            n_repeat = _per_doc(covered, bounds)
        if n in NGRAM_LIMITS:
            coverage[:, lengths.index(n)] = _per_doc(np.where(covered, chars, 0), bounds) / whole

    n_dup_lines, line_coverage = np.zeros(n_docs, np.int64), np.zeros(n_docs)
    for i, text in enumerate(texts):
        lines = text.split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            chars_dup = 0
            for line in lines:
                if line in seen:
                    n_dup_lines[i] += 1
                    chars_dup += sum(len(w.decode()) for w in line.split())
                elif line and not line.isspace():
                    seen.add(line)
            line_coverage[i] = chars_dup / whole[i]
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "coverage": coverage, "line_coverage": line_coverage,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (of the id's own type) and SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array([NGRAM_LIMITS[n] for n in sorted(NGRAM_LIMITS)])
        for batch in common.slices(batches, "text", 2 << 20):
            m = measure([(t or "").encode() for t in batch.column("text").to_pylist()])
            base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            repetitive = (m["coverage"] > limits).any(axis=1) | (m["line_coverage"] > LINE_LIMIT)
            flat = pa.array(m["coverage"].ravel())
            offsets = pa.array(np.arange(0, m["coverage"].size + 1, len(limits), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 pa.array(base_failed), pa.array(~base_failed & ~repetitive), pa.ListArray.from_arrays(offsets, flat), pa.array(m["line_coverage"])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "coverage", "line_coverage"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['id']}, {SCHEMA}")


def op7_repetition(spark, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))
