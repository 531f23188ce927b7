"""Operator 10, token-id output: static range asymmetric numeral system.

Documents are tokenized once; their ids are written to the shared folder and counted
there, over the whole corpus, into one shared frequency table of 2^TABLE_BITS slots.
Blocks of consecutive documents are then encoded independently.  Within a block LANES interleaved coders share the work, one
numpy step codes a token of every lane, and a checkpoint every CHECKPOINT steps holds
the lanes' states and their place in the words, so parts of a block can be decoded in
parallel.  Each block carries a CRC-32 of its payload, one of its tokens and one of
the table, which is a row of its own among the query's rows: blocks(), given those
rows alone, decodes them.

Defined results
- null or empty text: a document of 0 tokens, listed in its block; very long texts: whole,
  as a block is at least one document; repeated rows: each coded; null doc_id: listed as null;
- a token that the table lacks: an error, as the table counts the same documents;
- the table's row: no doc_ids or payload, its column table is null in all others;
- empty table: no blocks and no row of the table; other columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, docs_only, table
from .kernels import slice_batches
from .tokenizer import VOCABULARY, load_ranks

TABLE_BITS = 20
LANES = 512
#: Steps between checkpoints; a step is a token of every lane.
CHECKPOINT = 256
#: Bytes of text in a block, about.
BLOCK_BYTES = 1 << 20
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)

_ENCODERS: dict = {}

BLOCK_FIELDS = "doc_ids array<long>, doc_tokens array<int>, tokens long, steps int, words int, payload binary, checkpoint_states binary, checkpoint_words array<int>, payload_crc long, token_crc long, table_crc long, table binary"


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken
        from public_tokenizers import PATTERN

        _ENCODERS[path] = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODERS[path]


def token_ids(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the tokens of each text."""
    encode_one = _encoder(path).encode_to_numpy
    each = [encode_one(t or "", disallowed_special=()) for t in texts.to_pylist()]
    return (np.concatenate(each) if each else np.zeros(0, np.uint32)), np.array([len(x) for x in each], np.int64)


def id_blocks(df: DataFrame, path: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents of df(doc_id, text) with their token ids as little-endian integers, 16 bits wide where the vocabulary allows."""
    width = _width(path)

    def run(batches):
        for b in slice_batches(batches, size=block_bytes):
            ids, each = token_ids(b.column("text"), path)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((b.column("doc_id").to_pylist(), pa.list_(pa.int64())), (each.tolist(), pa.list_(pa.int32())), (ids.astype(width).tobytes(), pa.binary()))], ["doc_ids", "doc_tokens", "ids"])

    return docs_only(df).mapInArrow(run, "doc_ids array<long>, doc_tokens array<int>, ids binary")


def _width(path: str) -> str:
    return "<u2" if max(load_ranks(path).values()) < 1 << 16 else "<u4"


def frequencies(blocks: DataFrame, path: str = VOCABULARY) -> np.ndarray:
    """How often each id of the vocabulary occurs in all blocks."""
    size, width = max(load_ranks(path).values()) + 1, _width(path)

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), width), minlength=size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["id", "n"])

    got = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


@dataclass
class Table:
    """Slots of each symbol; freq sums to 2^bits, and each counted symbol has one at least."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray
    bits: int

    @staticmethod
    def build(counts: np.ndarray, bits: int = TABLE_BITS) -> Table:
        total, size = int(counts.sum()), 1 << bits
        seen = np.flatnonzero(counts)
        if len(seen) > size:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), np.int64)
        if total:
            share = counts[seen].astype(float) / total * size
            f = np.maximum(1, np.floor(share)).astype(np.int64)
            spare = size - int(f.sum())
            if spare >= 0:
                order = np.argsort(-(share - np.floor(share)), kind="stable")
                f += spare // len(f)
                f[order[: spare % len(f)]] += 1
            while spare < 0:  # take from the largest, where it costs least
                order = np.argsort(-f, kind="stable")
                take = order[f[order] > 1][: -spare]
                f[take] -= 1
                spare += len(take)
            freq[seen] = f
        return Table.of(freq, bits)

    @staticmethod
    def of(freq: np.ndarray, bits: int) -> Table:
        start = np.r_[0, np.cumsum(freq)[:-1]]
        return Table(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.int32), freq), bits)

    def pack(self) -> bytes:
        """The bits in a byte, then the slots of each symbol, deflated."""
        return bytes([self.bits]) + zlib.compress(self.freq.astype("<u4").tobytes())

    @staticmethod
    def unpack(data: bytes) -> Table:
        return Table.of(np.frombuffer(zlib.decompress(data[1:]), "<u4").astype(np.int64), data[0])


def encode(ids: np.ndarray, t: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """Payload of 32-bit words, states (checkpoints, lanes), the word each checkpoint reads next, and the steps.

    Token i belongs to lane i % lanes at step i // lanes.  Coding runs from the last
    step to the first, so that decoding runs forwards; checkpoint c is before step
    c * checkpoint.
    """
    steps = -(-len(ids) // lanes)
    padded = np.full(steps * lanes, -1, np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(steps, lanes)
    x = np.full(lanes, _LOW, np.uint64)
    bits = np.uint64(t.bits)
    shift = np.uint64(63 - t.bits)
    out: list[np.ndarray] = []
    sizes = np.zeros(steps + 1, np.int64)
    states = np.zeros((-(-steps // checkpoint), lanes), np.uint64)
    if len(ids) and (int(ids.max()) >= len(t.freq) or not t.freq[ids].all()):
        raise ValueError("a token that the table lacks")
    for k in range(steps - 1, -1, -1):
        row = grid[k]
        live = row >= 0
        s = row[live] if k == steps - 1 else row
        f, c = t.freq[s], t.start[s]
        y = x[live] if k == steps - 1 else x
        full = y >= (f << shift)
        # within a step lanes are written from the first to the last
        words = (y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out.append(words)
        sizes[k] = len(words)
        y = np.where(full, y >> _32, y)
        q = y // f
        y = (q << bits) + (y - q * f) + c
        if k == steps - 1:
            x[live] = y
        else:
            x = y
        if k % checkpoint == 0:
            states[k // checkpoint] = x
    payload = np.concatenate(out[::-1]).astype("<u4").tobytes() if out else b""
    places = np.r_[0, np.cumsum(sizes[:steps])][: steps + 1][::checkpoint][: len(states)]
    return payload, states, places.astype(np.int64), steps


def decode(payload: bytes, states: np.ndarray, places: np.ndarray, tokens: int, t: Table, part: int | None = None, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> np.ndarray:
    """All tokens of a block, or those from one checkpoint to the next alone."""
    words = np.frombuffer(payload, "<u4")
    steps = -(-tokens // lanes)
    mask, bits = np.uint64((1 << t.bits) - 1), np.uint64(t.bits)
    pieces_ = []
    for c in range(len(states)) if part is None else (part,):
        x, at = states[c].copy(), int(places[c])
        last = min(steps, (c + 1) * checkpoint)
        got = np.empty((last - c * checkpoint, lanes), np.int32)
        for k in range(c * checkpoint, last):
            slot = x & mask
            s = t.symbol[slot.astype(np.int64)]
            got[k - c * checkpoint] = s
            y = t.freq[s] * (x >> bits) + slot - t.start[s]
            live = np.arange(lanes) < tokens - k * lanes
            need = np.flatnonzero((y < _LOW) & live)
            y[need] = (y[need] << _32) | words[at : at + len(need)]
            at += len(need)
            x = np.where(live, y, x)
        pieces_.append(got.ravel()[: min(got.size, tokens - c * checkpoint * lanes)])
    return np.concatenate(pieces_) if pieces_ else np.zeros(0, np.int32)


def decode_row(row, t: Table, part: int | None = None) -> np.ndarray:
    """The tokens of a row of encoded(); the checksums are checked."""
    if zlib.crc32(row["payload"]) != row["payload_crc"]:
        raise ValueError("damaged payload")
    states = np.frombuffer(row["checkpoint_states"], "<u8").reshape(-1, LANES)
    ids = decode(row["payload"], states, np.array(row["checkpoint_words"]), row["tokens"], t, part)
    if part is None and zlib.crc32(ids.astype("<i4").tobytes()) != row["token_crc"]:
        raise ValueError("wrong tokens")
    return ids


def encoded(blocks: DataFrame, t: Table, path: str = VOCABULARY) -> DataFrame:
    """Range-coded blocks, each decodable alone with the table."""
    sent, width, crc = blocks.sparkSession.sparkContext.broadcast(t), _width(path), zlib.crc32(t.pack())

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), width)
                payload, states, places, steps = encode(ids, sent.value)
                rows.append((len(ids), steps, len(payload) // 4, payload, states.astype("<u8").tobytes(), places.tolist(), zlib.crc32(payload), zlib.crc32(ids.astype("<i4").tobytes()), crc, None))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["tokens", "steps", "words", "payload", "checkpoint_states", "checkpoint_words", "payload_crc", "token_crc", "table_crc", "table"]
            yield pa.RecordBatch.from_arrays([b.column("doc_ids"), b.column("doc_tokens"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_ids", "doc_tokens", *names])

    return blocks.mapInArrow(run, BLOCK_FIELDS)


def table_row(blocks: DataFrame, t: Table) -> DataFrame:
    """The table as a row like those of encoded(); none where there are no blocks."""
    data = t.pack()
    rows = [] if blocks.isEmpty() else [(None, None, None, None, None, None, None, None, None, None, zlib.crc32(data), data)]
    return blocks.sparkSession.createDataFrame(rows, BLOCK_FIELDS)


def blocks(rows) -> Iterator[tuple]:
    """(row, tokens) of each block among the query's rows, by the tables among them."""
    rows, tables = list(rows), {}
    for r in rows:
        if r["table"] is not None:
            if zlib.crc32(r["table"]) != r["table_crc"]:
                raise ValueError("damaged table")
            tables[r["table_crc"]] = Table.unpack(r["table"])
    for r in rows:
        if r["table"] is None:
            if r["table_crc"] not in tables:
                raise ValueError("a block without its table")
            yield r, decode_row(r, tables[r["table_crc"]])


def op10_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents as range-coded blocks, and the table that decodes them."""
    ids = cut(id_blocks(table(spark, sf_dir, "documents")))
    t = Table.build(frequencies(ids))
    return table_row(ids, t).unionByName(encoded(ids, t))
