"""Operator 4, token counts: a byte-pair tokenizer compiled to finite-state transducers.

Two deterministic transducers in a row count the tokens of a byte-level BPE
vocabulary exactly:

- the *splitter* reads character classes and marks where pieces begin (the public
  split pattern of these vocabularies).  It has ten states, so each chunk of a batch
  gets its full state map, from every state it could start in to the state it ends in;
  the maps compose associatively, and a parallel prefix scan over them gives every
  chunk its true first state, wherever the texts were cut;
- the *counter* reads the bytes of a piece.  Its states hold the longest suffix that
  can still grow into a token and the last tokens at the places within it; each
  transition is annotated with the change in the number of tokens, which may fall
  when tokens merge.  A sequence of tokens is the tokenizer's own exactly when each
  neighbouring pair is, which is a finite-state condition.  States and transitions
  are compiled when first needed and kept for the life of the worker.

Pieces are counted once for each distinct one in a batch, all in step, a byte of each
at a time.

Defined results
- null text: as an empty one, 0 tokens, 0 pieces; very long texts: all their tokens;
- special tokens' strings count as ordinary text; repeated rows, null doc_id: each counted;
- empty table: no rows; other columns: ignored.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import docs_only, table
from .kernels import flat, slice_batches, slices, span_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 256
#: A worker that holds more states begins anew with the next batch, so its memory is bounded.
STATES = 250_000

# character classes
_L, _N, _P, _SP, _WS, _AP, _s, _l, _re, _v, _e, _EOT = range(12)
_CLASSES = 12
# splitter states: nothing open; in letters, digits, other; after a space, after other white space; after an apostrophe that opens a piece, after 'r, 'v, 'l
_FRESH, _IL, _IN, _IP, _ISP, _IWS, _IAP, _IR, _IV, _ILL = range(10)
_STATES = 10


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state * classes + class], and marks: 1 this character begins a piece, 2 the one before does."""
    to = np.zeros((_STATES, _CLASSES), np.uint8)
    mark = np.zeros((_STATES, _CLASSES), np.uint8)
    letters = (_L, _s, _l, _re, _v, _e)
    group = {c: _IL for c in letters} | {_N: _IN, _P: _IP, _AP: _IP}
    for s in range(_STATES):
        for c in range(_CLASSES):
            if c == _EOT:
                to[s, c], mark[s, c] = _FRESH, 2 if s in (_IR, _IV, _ILL) else 0
                continue
            if c in (_SP, _WS):
                to[s, c] = _ISP if c == _SP else _IWS
                mark[s, c] = 0 if s in (_ISP, _IWS) else 1
                if s in (_IR, _IV, _ILL):
                    mark[s, c] |= 2
                continue
            g = group[c]
            m = 0
            if s == _ISP:
                m = 2
            elif s == _IWS:
                m = 3
            elif s == _IAP and c in (_s, _re, _v, _l, _e):
                # _s: letters that end a contraction alone; _re: r; _v: v; _l: l; _e: e, which begins none
                if c == _s:
                    to[s, c] = _FRESH
                    continue
                if c != _e:
                    to[s, c] = {_re: _IR, _v: _IV, _l: _ILL}[c]
                    continue
                m = 1
            elif (s in (_IR, _IV) and c == _e) or (s == _ILL and c == _l):
                to[s, c] = _FRESH
                continue
            elif s in (_IR, _IV, _ILL):
                m = 2 | (0 if g == _IL else 1)
            elif s == _IAP:
                m = 0 if g == _IP else 1
            else:
                m = 0 if s == g else 1
            to[s, c], mark[s, c] = g, m
            if c == _AP and m & 1 and s != _ISP:
                to[s, c] = _IAP
    return to.ravel(), mark.ravel()


_NEXT, _MARK = _splitter()
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point."""
    if not _CLASS:
        import regex

        a = np.full(0x110000, _P, np.uint8)
        space = regex.compile(r"\s")
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0] if not 0xD800 <= c < 0xE000 else "C"
            if k == "L":
                a[c] = _L
            elif k == "N":
                a[c] = _N
            elif k in "ZC" and space.match(chr(c)):
                a[c] = _WS
        for text, k in ((" ", _SP), ("'", _AP), ("stmd", _s), ("r", _re), ("v", _v), ("l", _l), ("e", _e)):
            a[[ord(x) for x in text]] = k
        _CLASS.append(a)
    return _CLASS[0]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first byte and code point of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    point = lead.copy()
    if len(data) > len(at):
        padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
        for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            k = np.flatnonzero(lead >= low)
            p = lead[k] & bits
            for j in range(1, more + 1):
                p = (p << 6) | (padded[at[k] + j] & 0x3F)
            point[k] = p
    return at, point


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks, states): row i takes a state through chunks 0 to i."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def pieces(texts: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts; first and past-the-end byte of each piece; and each text's first piece."""
    data, off = flat(texts)
    at, point = characters(data)
    docs = len(off) - 1
    # an end mark after each text
    where = np.searchsorted(at, off[1:])
    symbols = np.full(len(at) + docs, _EOT, np.uint8)
    own = np.arange(len(at)) + np.repeat(np.arange(docs), np.diff(np.r_[0, where]))
    symbols[own] = _classes()[point]
    n = len(symbols)
    chunks = max(1, -(-n // chunk))
    grid = np.full(chunks * chunk, _EOT, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, chunk).T)
    state = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], chunks, 1)
    for c in grid:
        state = _NEXT.take(state * np.uint8(_CLASSES) + c)
    whole = compose(np.ascontiguousarray(state.T))
    now = np.r_[np.uint8(_FRESH), whole[:-1, _FRESH]].astype(np.uint8)
    marks = np.empty((chunk, chunks), np.uint8)
    for j, c in enumerate(grid):
        k = now * np.uint8(_CLASSES) + c
        marks[j] = _MARK.take(k)
        now = _NEXT.take(k)
    marks = marks.T.ravel()[: n + 1]
    begins = (marks & 1).astype(bool)[:n]
    begins[:-1] |= (marks[1:n] & 2).astype(bool)
    start = at[np.flatnonzero(begins[own])]
    end = np.r_[start[1:], len(data)] if len(start) else start
    return data, start, end, np.searchsorted(start, off)


class Counter:
    """The lazily compiled transducer over bytes whose output is the change in the number of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.size = len(ranks)
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self._splits()
        prefixes = set()
        for t in ranks:
            prefixes.update(t[:k] for k in range(1, len(t)))
        self.prefixes = prefixes
        self.fine: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs = 0
        self._table(1 << 16)
        self.root = self._state((b"", (-1,), (0,)))

    def _table(self, size: int) -> None:
        self.key = np.full(size, -1, np.int64)
        self.to = np.zeros(size, np.int32)
        self.out = np.zeros(size, np.int8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def _put(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Adds transitions with distinct new keys."""
        self.arcs += len(key)
        if 2 * self.arcs > len(self.key):
            old = self.key >= 0
            key, to, out = np.r_[self.key[old], key], np.r_[self.to[old], to], np.r_[self.out[old], out]
            self._table(1 << (4 * self.arcs - 1).bit_length())
        k = self._slot(key)
        while len(key):
            free = self.key[k] < 0
            self.key[k[free]] = key[free]
            won = self.key[k] == key
            self.to[k[won]], self.out[k[won]] = to[won], out[won]
            key, to, out, k = key[~won], to[~won], out[~won], (k[~won] + 1) & (len(self.key) - 1)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each transition, -1 where it isn't compiled."""
        k = self._slot(key)
        seen = self.key[k]
        late = np.flatnonzero((seen != key) & (seen >= 0))
        while len(late):
            k[late] = (k[late] + 1) & (len(self.key) - 1)
            seen[late] = self.key[k[late]]
            late = late[(seen[late] != key[late]) & (seen[late] >= 0)]
        k[seen < 0] = -1
        return k

    def _splits(self) -> None:
        """The merge that makes each token: its two parts by the merges of lower rank."""
        ids = self.ids
        for token, rank in ids.items():
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    r = ids.get(parts[i] + parts[i + 1], rank)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                a, b = ids[parts[0]], ids[parts[1]]
                self.split[rank] = (a, b)
                self.pairs[a, b] = rank

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokenizer ever leaves b after a: no merge across them comes before those within them."""
        key = (a, b)
        if key not in self.fine:
            limit, ok = self.size, True
            while True:
                merged = self.pairs.get((a, b))
                if merged is not None and merged < limit:
                    ok = False
                    break
                # undo the later of the two last merges; bytes of one have none
                ra, rb = (a if a in self.split else -1), (b if b in self.split else -1)
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    limit, a = ra, self.split[a][1]
                else:
                    limit, b = rb + 1, self.split[b][0]
            self.fine[key] = ok
        return self.fine[key]

    def _state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state of a state by a byte, and the output.

        A state is (suffix that begins a token, last token at each place from before
        it to its end, number of tokens at those places less the one at the end).
        """
        suffix, last, count = self.states[state]
        text = suffix + bytes((byte,))
        m = len(text)
        for s in range(m):
            t = self.ids.get(text[s:])
            if t is not None and last[s] != -2 and (last[s] == -1 or self.fits(last[s], t)):
                break
        else:
            raise ValueError("a byte without a token")
        delta = count[s] + 1
        keep = next((s for s in range(m) if text[s:] in self.prefixes), m)
        last, count = (*last, t), (*count, delta)
        # places at which no token can begin that reaches past the end don't tell states apart
        open_ = [s == m or text[s:] in self.prefixes for s in range(keep, m + 1)]
        key = (text[keep:], tuple(x if o else -2 for x, o in zip(last[keep:], open_)), tuple(c - delta if o else 0 for c, o in zip(count[keep:], open_)))
        return self._state(key), delta

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each byte span, all spans in step."""
        if len(self.states) > STATES:
            self._clear()
        total = np.zeros(len(start), np.int64)
        state = np.full(len(start), self.root, np.int64)
        order = np.argsort(start - end, kind="stable")
        start, length = start[order], (end - start)[order]
        for j in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -j, "left"))
            key = state[:live] << 8 | data[start[:live] + j]
            k = self._find(key)
            missing = np.flatnonzero(k < 0)
            if len(missing):
                new = np.unique(key[missing])
                arcs = np.array([self._compile(x >> 8, x & 255) for x in new.tolist()], np.int64)
                self._put(new, arcs[:, 0], arcs[:, 1])
                k = self._find(key)
            total[:live] += self.out[k]
            state[:live] = self.to[k]
        result = np.empty_like(total)
        result[order] = total
        return result


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_COUNTERS: dict[str, Counter] = {}
_COUNTED: dict[str, dict] = {}


def counter(path: str = VOCABULARY) -> Counter:
    """The worker's transducer for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_ranks(path))
    return _COUNTERS[path]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct content, and for every span the number of its content."""
    h = span_hash(data, start, end)
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return at, inverse


def count_tokens(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pieces of each text."""
    data, start, end, first = pieces(texts)
    at, inverse = distinct(data, start, end)
    each = counter(path).count(data, start[at], end[at])[inverse]
    run = np.r_[0, np.cumsum(each)]
    return run[first[1:]] - run[first[:-1]], np.diff(first)


def token_counts(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens and pieces of every row of df(doc_id, text)."""

    def run(batches):
        for b in slice_batches(batches):
            tokens, n = count_tokens(b.column("text"), path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "tokens", "pieces"])

    return docs_only(df).mapInArrow(run, "doc_id long, tokens long, pieces long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
