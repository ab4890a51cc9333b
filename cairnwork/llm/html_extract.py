"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks, decoded by Viterbi.

A page is cut at block-level tags; each stretch of text between two cuts is a leaf block, known by the chain of its
ancestors. Features are the ancestors' tags and attribute words and the shape of the text (length, share of link
text, punctuation, place on the page, repetition of the title). The chain has two labels, main text and other, with
weights for features by label and for pairs of neighbouring labels. It is trained by gradient ascent (Adam, full
forward-backward) on labelled pages made by html_pages; their number and seed are parameters, so the model is the
same everywhere and its size does not depend on the pages to be read. Main blocks, in page order, are joined by \\n.

Cases: null or empty html, or a page without main text, gives an empty text. Head, script, style, comments and other
invisible content never make a block. Unclosed, crossed and cut-off tags are tolerated; a tag with a quote that is not
closed ends at its first >. A block's ancestors are its NEAREST innermost ones, and reading a page takes time linear in
its length, however broken it is. White space inside a block is one space. Rows are independent: repeated rows give
repeated results, an empty table none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common, html_pages

#: Tags that bound a block, that have no content, and whose content is never seen.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option optgroup p pre section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: A tag on the left is closed by the opening of one on the right.
CLOSED_BY = {
    "p": BLOCK - {"button", "label", "option", "legend", "caption", "td", "th", "tr", "select"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "head": {"body"},
}

NEAREST = 64
_name = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_stop = re.compile(r"[>\"']")
_named = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_part = re.compile(r"[a-z]+")
_closing = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_space = re.compile(r"\s+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, tuple[str, ...]], ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def _attribute_words(attributes: str) -> tuple[str, ...]:
    return _words_of(attributes) if len(attributes) < 500 else _words_of.__wrapped__(attributes)


@lru_cache(4096)
def _words_of(attributes: str) -> tuple[str, ...]:
    found = {w for m in _named.finditer(attributes) for w in _part.findall((m[1] or m[2] or m[3] or "").lower())}
    return tuple(sorted(found))


class Tags:
    """The tags of a page, from any position on.

    A quote counts as one only after =. Its closing one may have markup before it if the value ends like one there;
    otherwise the quote is taken as never closed, and the tag ends at its first >.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def _end(self, at: int) -> int:
        page, last = self.page, self.last
        while at <= last[">"]:
            m = _stop.search(page, at)
            at = m.end()
            if m[0] == ">":
                return at
            if page[m.start() - 1] != "=" and not page[max(0, m.start() - 20) : m.start()].rstrip().endswith("="):
                continue
            close = page.find(m[0], at) if at <= last[m[0]] else -1
            if close < 0 or page.find("<", at, close) >= 0 and page[close + 1 : close + 2] not in (" ", "\t", "\n", "\r", "/", ">"):
                return page.find(">", at) + 1
            at = close + 1
        return 0

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(from, to, name, closing, attributes) of the next tag; comments, doctypes and the like have an empty name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", False, ""
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1 if at < self.last[">"] else len(page), "", False, ""
            if m := _name.match(page, at + 1):
                end = self._end(m.end())
                return (at, end, m[1].lower(), page[at + 1] == "/", page[m.end() : end - 1]) if end else None
            at += 1
        return None


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, white space inside them made one space, character references decoded."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    open_: Counter[str] = Counter()
    hidden = links = 0
    linked: list[str] = []

    def flush() -> None:
        if text:
            whole = _space.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                share = len(_space.sub(" ", entities.unescape("".join(linked))).strip()) / len(whole)
                blocks.append(Block(whole, tuple(stack[-NEAREST:]), min(1.0, share)))
            text.clear()
            linked.clear()

    def said(part: str) -> None:
        if part and not hidden:
            text.append(part)
            if links:
                linked.append(part)

    def drop_to(depth: int) -> None:
        nonlocal hidden
        for tag, _ in stack[depth:]:
            hidden -= tag in HIDDEN
            open_[tag] -= 1
        del stack[depth:]

    at, scan = 0, Tags(page)
    while found := scan.after(at):
        start, end, tag, closing, attributes = found
        said(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in HIDDEN:
                flush()
                if open_[tag]:
                    drop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                links = 0 if tag in BLOCK else links
            continue
        if tag == "br":
            said(" ")
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK or tag in HIDDEN:
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                drop_to(len(stack) - 1)
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, _attribute_words(attributes)))
                open_[tag] += 1
                hidden += tag in HIDDEN
                if tag in RAW:
                    close = _closing[tag].search(page, at)
                    said(page[at : close.start() if close else len(page)])
                    flush()
                    drop_to(len(stack) - 1)
                    at = close.end() if close else len(page)
    said(re.sub(r"<[/a-zA-Z!?].*\Z", "", page[at:], flags=re.S))
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        f = ["bias", f"own={b.path[-1][0] if b.path else ''}", f"words={min(7, words.bit_length())}", f"linked={int(4 * b.linked)}"]
        f += sorted({f"tag={t}" for t, _ in b.path} | {f"attr={w}" for _, ws in b.path for w in ws})
        f.append(f"place={5 * i // n}")
        f.append(f"ends={b.text[-1] if b.text[-1] in '.!?:,' else 'other'}")
        if b.text[0] == "©" or "©" in b.text[:40]:
            f.append("copyright")
        f.append(f"comma={min(3, b.text.count(','))}")
        if i:
            f.append("same parent as before" if blocks[i - 1].path[:-1] == b.path[:-1] else "other parent than before")
        out.append(f)
    return out


class Crf:
    """Two labels; weights of (feature, label) and of (label, next label)."""

    def __init__(self, index: dict[str, int], state: np.ndarray, step: np.ndarray):
        self.index, self.state, self.step = index, state, step

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        known = self.index
        return np.array([self.state[[known[x] for x in f if x in known]].sum(axis=0) for f in rows])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        (a, b), (c, d) = self.step.tolist()
        rows = scores.tolist()
        best0, best1 = rows[0]
        back: list[tuple[int, int]] = []
        for s0, s1 in rows[1:]:
            to0, to1 = (best0 + a, best1 + c), (best0 + b, best1 + d)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best0, best1 = max(to0) + s0, max(to1) + s1
        label = int(best1 > best0)
        path = [label]
        for pair in reversed(back):
            label = pair[label]
            path.append(label)
        return path[::-1]

    def main_blocks(self, page: str | None) -> list[str]:
        blocks = leaf_blocks(page) if page else []
        if not blocks:
            return []
        labels = self.viterbi(self.scores(features(blocks)))
        return [b.text for b, label in zip(blocks, labels, strict=True) if label]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradient(scores: np.ndarray, step: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of one page's labels, and its gradient in the scores and the steps, by forward-backward."""
    n = len(scores)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = _log_sum(forward[i - 1][:, None] + step, 0) + scores[i]
    for i in range(n - 2, -1, -1):
        backward[i] = _log_sum(step + (scores[i + 1] + backward[i + 1])[None, :], 1)
    total = _log_sum(forward[-1], 0)
    by_state = -np.exp(forward + backward - total)
    by_step = np.zeros((2, 2))
    if n > 1:
        by_step -= np.exp(forward[:-1, :, None] + step + (scores[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
        np.add.at(by_step, (labels[:-1], labels[1:]), 1)
    by_state[np.arange(n), labels] += 1
    value = scores[np.arange(n), labels].sum() + step[labels[:-1], labels[1:]].sum() - total
    return float(value), by_state, by_step


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.1, shrink: float = 1e-3, least: int = 3) -> Crf:
    """Adam over pages in order; features seen in fewer than `least` blocks are left out."""
    seen: dict[str, int] = {}
    for rows, _ in pages:
        for f in rows:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= least))}
    state, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    coded = [([np.array([index[x] for x in f if x in index]) for f in rows], np.array(labels)) for rows, labels in pages]
    moments = [np.zeros_like(x) for x in (state, state, step, step)]
    for t in range(1, rounds * len(coded) + 1):
        rows, labels = coded[(t - 1) % len(coded)]
        scores = np.array([state[f].sum(axis=0) for f in rows])
        _, by_state, by_step = gradient(scores, step, labels)
        full = -shrink * state
        for f, g in zip(rows, by_state, strict=True):
            full[f] += g
        for i, (x, g) in enumerate(((state, full), (step, by_step - shrink * step))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate / np.sqrt(1 + t / len(coded)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Crf(index, state, step)


MARKS = ("\ue000", "\ue001")  # private characters that stand before text of either label while a made page is parsed


def labelled(seed: int) -> tuple[list[list[str]], list[int], str, str]:
    """One made page: features, labels, html, main text. A block takes the label of the fragment that its text begins in."""
    fragments = html_pages.page(seed)
    marked = "".join(x if label is None else re.sub(r">([^<])", rf">{MARKS[label]}\1", x, count=1) for x, label in fragments)
    blocks = leaf_blocks(marked)
    labels, last = [], 0
    for b in blocks:
        mark = next((c for c in b.text if c in MARKS), None)
        last = last if mark is None else MARKS.index(mark)
        labels.append(last)
        b.text = re.sub("[" + "".join(MARKS) + "]", "", b.text).strip() or " "
    page = "".join(x for x, _ in fragments)
    return features(blocks), labels, page, "\n".join(b.text for b, k in zip(blocks, labels, strict=True) if k)


@lru_cache(2)
def default_model(pages: int = 500, seed: int = 20_000) -> Crf:
    return train([x[:2] for i in range(pages) if (x := labelled(seed + i))[0]])


def extract(pages: DataFrame, model: Crf | None = None, html_col: str = "html") -> DataFrame:
    """pages without html_col, and text, n_chars, n_blocks (which replace columns of those names)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    new = ("text", "n_chars", "n_blocks")
    own = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in new and c != html_col], F.col(f"`{html_col}`").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__html") + ", text string, n_chars long, n_blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in common.slices(batches, "__html"):
            found = [crf.main_blocks(x) for x in batch.column("__html").to_pylist()]
            texts = ["\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int32())],
                names=[*batch.schema.names[:-1], *new],
            )

    return own.mapInArrow(run, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages)
