"""Token counts by finite-state compilation of a byte-level BPE tokenizer, without making a single token.

Two deterministic transducers read a text, and their transitions carry what is emitted:

* The splitter has eleven states over classes of characters. A transition marks where pre-tokens begin: at this character,
  or (where the pattern looks ahead) at the one before.
* The counter reads bytes and returns to its start state where a pre-token begins. Its transitions carry how many tokens
  more (or fewer, where bytes come to be merged) the encoding of what was read so far has, so a sum over transitions is
  the count. It is compiled as it is used: a state stands for all prefixes with the same future, that is, for every end
  of the prefix that may still grow into a token, the token that stands before it and the tokens up to there. The token
  at an end is the one that may follow the token before it: two tokens may be neighbours if the encoding of both together
  is these two. States are numbered when first met; a full table is emptied and what is in use compiled anew, so memory
  is bounded by `states` whatever the text.

Texts are read in parallel, a batch at a time: chunks of CHUNK characters are lanes of numpy arrays. The splitter does not
know in which state a chunk begins, so it runs from all states until they have met, which gives a chunk's state map, and
the maps compose by a prefix scan of log2 steps to the state each chunk begins in. A document's first chunk has a constant
map, so that a scan over many documents keeps them apart. The counter's map of a chunk is constant from the first
pre-token on; its lanes are therefore cut where a pre-token begins, and what lies before is run with the chunk it began in.

Spark deals the rows; nothing is shuffled. Strings of added tokens count one each, as in the library.

Cases: a null or empty text has no tokens and 0 bytes. Rows are independent: repeated rows give repeated results, an empty
table none. Very long texts are a batch of their own and as parallel as many short ones; a single pre-token of great length
is read byte by byte. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm import common

CHUNK = 1024
#: Classes of characters. Letters of contractions have classes of their own.
LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE, STMD, RV, L, E, ADDED, UNKNOWN = range(12)
LETTERS = (LETTER, STMD, RV, L, E)
#: States of the splitter: at a start; in a run of letters, numbers, others; after one space, one other white character, two
#: or more of them that end with a space, with another; after a quote at a start; after that and r or v; after that and l.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, SPACES, WHITES, QUOTED, QUOTED_RV, QUOTED_L = range(11)
N_STATES = 11
#: Of at most so many tokens it is found out which may still come.
FEW = 100
HERE, BEFORE = 1, 2  # where a pre-token begins
SURROGATE = 0xD800  # stands for an added token: no text has it
ADDED_SYMBOL = 256
_SHIFT, _ZERO = 6, 32  # an entry of the counter's table: next state, and tokens emitted + _ZERO


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, by state and class."""
    runs = {**{c: IN_LETTERS for c in LETTERS}, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    begins = {**runs, QUOTE: QUOTED, SPACE: ONE_SPACE, WHITE: ONE_WHITE, ADDED: START}
    joins = {**runs, QUOTE: IN_OTHERS}  # what a space can precede within a pre-token
    white = {SPACE: SPACES, WHITE: WHITES}

    def step(state: int, c: int) -> tuple[int, int]:
        afresh = begins[c], HERE
        if state == IN_LETTERS:
            return (IN_LETTERS, 0) if c in LETTERS else afresh
        if state == IN_NUMBERS:
            return (IN_NUMBERS, 0) if c == NUMBER else afresh
        if state == IN_OTHERS:
            return (IN_OTHERS, 0) if c in (OTHER, QUOTE) else afresh
        if state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
            if c in white:
                return white[c], 0
            if c == ADDED:
                return afresh
            split_off = BEFORE if state in (SPACES, WHITES) else 0  # the last of two or more white characters
            return (joins[c], split_off) if state in (ONE_SPACE, SPACES) else (begins[c], HERE | split_off)
        if state == QUOTED:
            return {STMD: (START, 0), RV: (QUOTED_RV, 0), L: (QUOTED_L, 0), OTHER: (IN_OTHERS, 0), QUOTE: (IN_OTHERS, 0)}.get(c, afresh)
        if state in (QUOTED_RV, QUOTED_L):
            if c == (E if state == QUOTED_RV else L):
                return START, 0
            to, mark = step(IN_LETTERS, c)  # no contraction: the letter before begins a run
            return to, mark | BEFORE
        return afresh

    table = np.array([[step(s, c) for c in range(ADDED + 1)] for s in range(N_STATES)], np.uint8)
    return np.ascontiguousarray(table[:, :, 0]), np.ascontiguousarray(table[:, :, 1])


NEXT, MARK = _splitter()


def entry_states(maps: np.ndarray, longest: int) -> np.ndarray:
    """The state each chunk is entered in, from the chunks' maps (chunk, state) in order; first chunks have constant maps."""
    maps, d = maps.copy(), 1
    while d < longest:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        d *= 2
    entered = np.full(len(maps), START, np.uint8)
    entered[1:] = maps[:-1, 0]
    return entered


def _lanes(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(k, how many lanes have an element k), lanes being sorted by length, longest first."""
    ends = np.sort(lengths)
    for k in range(int(ends[-1]) if len(ends) else 0):
        yield k, len(ends) - int(np.searchsorted(ends, k, "right"))


def pretoken_starts(classes: np.ndarray, doc_starts: np.ndarray, doc_lengths: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pre-token begins at each character of the documents, which stand one after another."""
    n_chunks = -(-doc_lengths // chunk)
    doc_of = np.repeat(np.arange(len(doc_starts)), n_chunks)
    first = np.cumsum(n_chunks) - n_chunks
    nth = np.arange(len(doc_of)) - first[doc_of]
    starts = doc_starts[doc_of] + nth * chunk
    lengths = np.minimum(chunk, doc_lengths[doc_of] - nth * chunk)
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]

    exits = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], len(at), 1)
    exits[:, nth[order] == 0] = START
    marks, early, state, met = np.zeros(len(classes), np.uint8), [], None, 0
    for k, m in _lanes(at, size):
        c = classes[at[:m] + k]
        if state is None:
            early.append(MARK[exits[:, :m], c])
            exits[:, :m] = NEXT[exits[:, :m], c]
            if (exits[:, :m] == exits[0, :m]).all():
                state, met = exits[0, :m].copy(), m
        else:
            marks[at[:m] + k] = MARK[state[:m], c]
            state[:m] = NEXT[state[:m], c]
    if state is not None:
        exits[:, :met] = state
    maps = np.empty((len(at), N_STATES), np.uint8)
    maps[order] = exits.T
    entered = entry_states(maps, int(n_chunks.max(initial=0)))
    entered[nth == 0] = START
    for k, found in enumerate(early):
        m = found.shape[1]
        marks[at[:m] + k] = found[entered[order[:m]], np.arange(m)]

    begins = marks & HERE
    begins[:-1] |= marks[1:] >> 1
    # where a text ends within a contraction that is none
    last = np.flatnonzero(doc_lengths > 0)
    final = (first + n_chunks - 1)[last]
    left = maps[final, entered[final]]
    begins[(doc_starts + doc_lengths - 1)[last[(left == QUOTED_RV) | (left == QUOTED_L)]]] = 1
    return begins.astype(bool)


class Counter:
    """The compiled tokenizer: the classes of characters, and the transducer that counts the tokens of pre-tokens."""

    _loaded: dict[tuple[str, int], Counter] = {}

    def __init__(self, path: str, states: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.states = self.tokenizer.model, states
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take white space with them are not supported")
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        # the byte alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        back = {c: b for b, c in self.letters.items()}
        tokens = {bytes(back[c] for c in p): i for p, i in self.tokenizer.get_vocab().items() if p not in strings}
        self._read_merges(json.loads(self.tokenizer.to_str())["model"], {p: i for p, i in self.tokenizer.get_vocab().items()})
        # a token that its own bytes are not encoded as is never emitted
        self.tokens = {t: i for t, i in tokens.items() if len(self.model.tokenize("".join(self.letters[b] for b in t))) == 1}
        self.longer: dict[bytes, list[int]] = {}
        for t, i in self.tokens.items():
            for n in range(1, len(t)):
                self.longer.setdefault(t[:n], []).append(i)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[SURROGATE] = ADDED
        for c, own in {"'": QUOTE, " ": SPACE, "r": RV, "v": RV, "l": L, "e": E, "s": STMD, "t": STMD, "m": STMD, "d": STMD}.items():
            self.classes[ord(c)] = own
        self._empty()

    @classmethod
    def load(cls, path: str, states: int) -> Counter:
        if (path, states) not in cls._loaded:
            cls._loaded[path, states] = cls(path, states)
        return cls._loaded[path, states]

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        """Classes by the tokenizer's own splitting, asked once for each character."""
        found = self.classes[points]
        new = np.unique(points[found == UNKNOWN])
        for p in new.tolist():
            alike = (kind for kind, with_it in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(with_it + chr(p))) == 1)
            self.classes[p] = next(alike, WHITE)
        return self.classes[points] if len(new) else found

    def _read_merges(self, model: dict, numbers: dict[str, int]) -> None:
        """What of a token can be merged with what stands next to it, before the token is whole.

        While a token is merged, its right edge is held by ever longer parts: each from its own merge to the one that
        takes it in, the token itself for ever. Likewise its left edge.
        """
        pairs = [tuple(numbers[x] for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        made = {numbers["".join(m.split(" ") if isinstance(m, str) else m)]: pair for m, pair in zip(model["merges"], pairs, strict=True)}
        if len(made) < len(pairs):
            raise ValueError("tokens that several merges make are not supported")
        soonest: dict[int, int] = {}
        for (left, _), r in self.rank.items():
            soonest.setdefault(left, r)

        def edge(token: int, side: int) -> list[tuple[int, int]]:
            found, until = [], len(pairs)
            while True:
                found.append((token, until))
                if token not in made:
                    return found
                until, token = self.rank[made[token]], made[token][side]

        alike: dict[tuple, int] = {(): -1}
        self.left, self.right, self.as_last = {}, {}, {}
        for token in numbers.values():
            self.left[token] = edge(token, 0)
            # parts that nothing can be merged with in their time make no difference
            right = tuple((part, until) for part, until in edge(token, 1) if soonest.get(part, until) < until)
            self.as_last[token] = alike.setdefault(right, token)  # one token stands for all with the same right edge
            self.right[self.as_last[token]] = right

    # A state is a tuple of (bytes since an end, token before them, tokens up to there less those up to here), for all
    # ends whose bytes begin a token that may still come, the farthest first; the nearest end is here. The token is one
    # that allows the same tokens after it, or -1 if any may follow.

    def _empty(self) -> None:
        self.hopes: dict[tuple[bytes, int], int | None] = {}
        self.allowing: dict[tuple, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.table = np.full((1024, ADDED_SYMBOL + 1), -1, np.int32)
        self._number(((b"", -1, 0),))

    def _number(self, state: tuple) -> int:
        n = self.numbers.setdefault(state, len(self.numbers))
        if n == len(self.known):
            self.known.append(state)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether no part of b is merged with a part of a first; of equal merges the left one comes first."""
        if a < 0:
            return True
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def _hope(self, since: bytes, last: int) -> int | None:
        """A token to stand for `last` before longer tokens that begin with `since`; None if none of them may follow."""
        if last < 0:
            return last if since in self.longer else None
        if (since, last) not in self.hopes:
            longer = self.longer.get(since, [])
            if len(longer) > FEW:
                self.hopes[since, last] = last
            else:
                allowed = tuple(t for t in longer if self._may_follow(last, t))
                self.hopes[since, last] = None if not allowed else -1 if len(allowed) == len(longer) else self.allowing.setdefault((since, allowed), last)
        return self.hopes[since, last]

    def compile(self, state: int, symbol: int) -> None:
        """The transition of a state with a symbol (a byte, or an added token)."""
        if symbol == ADDED_SYMBOL:
            self.table[state, symbol] = 1 + _ZERO
            return
        byte = bytes([symbol])
        grown = [(since + byte, token, n) for since, token, n in self.known[state]]
        last, count = next((self.tokens[since], n + 1) for since, token, n in grown if since in self.tokens and self._may_follow(token, self.tokens[since]))
        if not -_ZERO < count < _ZERO:
            raise OverflowError("a transition emits more tokens than an entry holds")
        hopeful = ((since, self._hope(since, token), n - count) for since, token, n in grown)
        to = self._number((*(x for x in hopeful if x[1] is not None), (b"", self.as_last[last], 0)))
        self.table[state, symbol] = (to << _SHIFT) + count + _ZERO

    def _compile_missing(self, state: np.ndarray, symbols: np.ndarray, lanes: np.ndarray) -> None:
        """Compile the transitions that these lanes need; if the table is full, only states in use stay."""
        if len(self.known) + len(lanes) > max(self.states, 2 * len(state)):
            used, where = np.unique(state, return_inverse=True)
            kept = [self.known[s] for s in used.tolist()]
            self._empty()
            state[:] = np.array([self._number(s) for s in kept], state.dtype)[where]
        for s, symbol in set(zip(state[lanes].tolist(), symbols.tolist(), strict=True)):
            if self.table[s, symbol] < 0:
                self.compile(s, symbol)

    def run(self, symbols: np.ndarray, begins: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens in each lane of symbols; `begins` marks where pre-tokens begin, and each lane starts with one."""
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state, counts, wide = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.int32(ADDED_SYMBOL + 1)
        goes_on = (~begins).astype(np.int32)
        for k, m in _lanes(at, size):
            if m < 8 and k > CHUNK:
                break
            place = at[:m] + k
            symbol, own = symbols[place], state[:m]
            own *= goes_on[place]
            entry = self.table.ravel()[own * wide + symbol]
            while entry.min() < 0:
                missing = np.flatnonzero(entry < 0)
                self._compile_missing(state, symbol[missing], missing)
                entry = self.table.ravel()[own * wide + symbol]
            counts[:m] += (entry & (2 * _ZERO - 1)) - _ZERO
            np.right_shift(entry, _SHIFT, out=own)
        else:
            k = int(size[0]) if len(size) else 0
        for i in np.flatnonzero(size > k).tolist():  # what is left of a few very long lanes
            s, table = state[i : i + 1], self.table
            for p in range(int(at[i]) + k, int(at[i] + size[i])):
                s *= goes_on[p]
                if table[s[0], symbols[p]] < 0:
                    self._compile_missing(s, symbols[p : p + 1], np.zeros(1, np.int64))
                    table = self.table
                entry = int(table[s[0], symbols[p]])
                counts[i] += (entry & (2 * _ZERO - 1)) - _ZERO
                s[0] = entry >> _SHIFT
        out = np.empty(len(at), np.int64)
        out[order] = counts
        return out

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        if self.added:
            texts = [self.added.sub(chr(SURROGATE), t) if self.added.search(t) else t for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        points = data if len(data) == len(whole) else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(lengths)
        begins = pretoken_starts(self.classes_of(points), ends - lengths, lengths, chunk)

        # from characters to symbols: bytes, and one symbol for each added token
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        symbols = data.astype(np.int32)
        stand_ins = leads[points == SURROGATE]
        if len(stand_ins):
            symbols[stand_ins] = ADDED_SYMBOL
            stays = np.ones(len(symbols), bool)
            stays[stand_ins + 1] = stays[stand_ins + 2] = False
            symbols, leads = symbols[stays], (np.cumsum(stays) - 1)[leads]
        begins_at = leads[begins]
        marked = np.zeros(len(symbols), bool)
        marked[begins_at] = True
        bounds = np.concatenate((leads, [len(symbols)]))
        doc_starts, doc_ends = bounds[ends - lengths], bounds[ends]

        sizes = doc_ends - doc_starts
        n_cuts = -(-sizes // chunk)
        doc_of = np.repeat(np.arange(len(texts)), n_cuts)
        wanted = doc_starts[doc_of] + (np.arange(len(doc_of)) - (np.cumsum(n_cuts) - n_cuts)[doc_of]) * chunk
        cuts = np.append(begins_at, len(symbols))[np.searchsorted(begins_at, wanted)]
        cuts = np.unique(cuts[cuts < len(symbols)])
        counts = self.run(symbols, marked, cuts, np.diff(cuts, append=len(symbols)))
        owner = np.searchsorted(doc_starts, cuts, "right") - 1
        return np.bincount(owner, counts, len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024, states: int = 1 << 16) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(vocabulary, states)
        for batch in common.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            tokens = counter.count(texts)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
