"""Problem 8: every text as the ids of a public byte-level BPE tokenizer.

Pieces of text are encoded in bulk: the distinct pieces of a slice of the corpus stand as rows of padded id matrices,
one matrix for each band of lengths. In each round every row merges its leftmost pair of least rank; ranks come from a
hash table over pairs, only the two pairs beside a merge are looked up again, and rows that are done leave the matrix.
A piece met before is not encoded again: its ids lie in a pool that is emptied when it outgrows ``POOL_PIECES``.

Defined results: null and empty texts give an empty list; strings that look like special tokens are plain text; whole
texts are encoded, however long; a text that is no valid UTF-8 can't occur in a string column. Repeated rows give
repeated rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.runtime import map_batches, table

TOKENIZERS = os.environ.get("QUILLMESH_TOKENIZERS", "/opt/tokenizers")
#: Pieces whose ids are kept between slices, in each Python worker; and the longest piece, in bytes, that is kept.
POOL_PIECES = 300_000
POOL_BYTES = 64
#: Characters of text that are worked on at once.
SLICE_CHARS = 2_000_000
#: Fixed value: how the public tokenizer parts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int32).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: for each token's bytes its rank, which is also its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairRanks:
    """A hash table from pairs of ids to the rank of what they join to; its size follows from the vocabulary alone."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        self.probes, at, rest = 0, self._slot(keys), np.arange(len(keys))
        while len(rest):  # linear probing, all keys a step at a time
            self.probes += 1
            free = self.keys[at[rest]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[rest[free]], return_index=True)
            placed = rest[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where two ids do not join or one is padding (-1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            held, sought = self.keys[at[open_]], keys[open_]
            hit = held == sought
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def find_one(self, left: int, right: int) -> int:
        """:func:`find` for one pair."""
        key = left << 32 | right
        at = (key * int(_MULTIPLIER) & 2**64 - 1) >> 64 - self.bits
        while (held := int(self.keys[at])) != key:
            if held == 2**64 - 1:
                return int(_NONE)
            at = at + 1 & (1 << self.bits) - 1
        return int(self.values[at])


def _merge_rows(ids: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a padded matrix, merged until no pair joins; returns the matrix and the new lengths."""
    n, width = ids.shape
    done, done_len = ids.copy(), lengths.copy()
    if width < 2:
        return done, done_len
    rows = np.arange(n)
    ranks = pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    while True:
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        go = best != _NONE
        if not go.all():  # rows that are done leave
            over = ~go
            done[rows[over], : ids.shape[1]] = ids[over]
            done_len[rows[over]] = lengths[over]
            rows, ids, lengths, ranks, at, best = rows[go], ids[go], lengths[go], ranks[go], at[go], best[go]
        if not len(rows):
            return done, done_len
        k = np.arange(len(rows))
        column = np.arange(ids.shape[1] - 1)
        ids[:, 1:-1] = np.where(column[None, 1:] > at[:, None], ids[:, 2:], ids[:, 1:-1])
        ids[:, -1] = np.where(at == ids.shape[1] - 2, -1, ids[:, -1])
        ids[k, at] = best
        lengths = lengths - 1
        ids[k, lengths] = -1
        if ranks.shape[1] > 1:
            ranks[:, 1:-1] = np.where(column[None, 1:-1] > at[:, None], ranks[:, 2:], ranks[:, 1:-1])
        ranks[:, -1] = _NONE
        left = np.maximum(at - 1, 0)
        around = pairs.find(np.concatenate([ids[k, at], ids[k, left]]), np.concatenate([ids[k, np.minimum(at + 1, ids.shape[1] - 1)], ids[k, at]]))
        keep = at < ranks.shape[1]
        ranks[k[keep], at[keep]] = np.where(at + 1 < ids.shape[1], around[: len(k)], _NONE)[keep]
        has_left = at > 0
        ranks[k[has_left], left[has_left]] = around[len(k) :][has_left]
        longest = int(lengths.max())
        if longest < ids.shape[1] and longest >= 2:  # drop columns that hold padding alone
            ids, ranks = np.ascontiguousarray(ids[:, :longest]), np.ascontiguousarray(ranks[:, : longest - 1])


def _merge_long(ids: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """One long piece, merged like a row of the matrix, always at the leftmost pair of least rank; a heap finds it."""
    n = len(ids)
    after, before, at = list(range(1, n + 1)), list(range(-1, n - 1)), ids.tolist()
    heap = [(rank, i, at[i], at[i + 1]) for i, rank in enumerate(pairs.find(ids[:-1], ids[1:]).tolist()) if rank != _NONE]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if at[i] != left or j >= n or at[j] != right:
            continue  # one of the two has been merged since
        at[i], at[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m < n and (found := pairs.find_one(at[k], at[m])) != _NONE:
                heapq.heappush(heap, (found, k, at[k], at[m]))
    return np.array([x for x in at if x >= 0], np.int32)


def encode_pieces(pieces: list[bytes], pairs: PairRanks) -> list[np.ndarray]:
    """The ids of each piece."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    edges = [0, 1, 2, 4, 6, 8, 12, 16, 24, 32, POOL_BYTES]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        chosen = np.flatnonzero((lengths > low) & (lengths <= high))
        for start in range(0, len(chosen), 50_000):
            part = chosen[start : start + 50_000]
            if not len(part):
                continue
            flat = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
            size = lengths[part]
            ids = np.full((len(part), high), -1, np.int32)
            ids[np.arange(high)[None, :] < size[:, None]] = pairs.byte_ids[flat]
            ids, size = _merge_rows(ids, size, pairs)
            for i, row, m in zip(part.tolist(), ids, size.tolist(), strict=True):
                out[i] = row[:m]
    for i in np.flatnonzero(lengths > POOL_BYTES).tolist():
        out[i] = _merge_long(pairs.byte_ids[np.frombuffer(pieces[i], np.uint8)], pairs)
    return out


class Encoder:
    """Texts to ids, with a pool of the pieces met so far."""

    def __init__(self, pairs: PairRanks):
        import regex

        self.pairs, self.parts = pairs, regex.compile(PIECES)
        self._empty()

    def _empty(self) -> None:
        self.code: dict[str, int] = {}
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        found = encode_pieces([p.encode() for p in new], self.pairs)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.pool) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *found])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and the number of each text's ids."""
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = self.parts.findall(text)
                counts[i] = len(parts)
                flat += parts
        if not flat:
            return np.empty(0, np.int32), counts
        if len(self.code) > POOL_PIECES:
            self._empty()
        new = list(dict.fromkeys(p for p in flat if p not in self.code))
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        sizes, starts = self.sizes[codes], self.starts[codes]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        if any(len(p) > POOL_BYTES for p in new):  # a piece of any length is encoded, but not kept
            self._empty()
        return ids, bounds[last] - bounds[last - counts]


def encode_column(df: DataFrame, text: str, name: str, keep: list[str], path: str) -> DataFrame:
    """Columns ``keep`` of ``df`` and the ids of column ``text`` as ``name``; ``path`` is the vocabulary on the driver.

    The vocabulary goes out as a broadcast: its size is that of the file, whatever the size of ``df``.
    """
    with open(path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    holder: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> pa.Table:
        if not holder:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
            holder.append(Encoder(PairRanks(ranks)))
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        tables, start, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= SLICE_CHARS or i == len(texts) - 1:
                ids, counts = holder[0].encode(texts[start : i + 1])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                part = batch.slice(start, i + 1 - start)
                tables.append(pa.Table.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), column], names=[*keep, name]))
                start, size = i + 1, 0
        return pa.concat_tables(tables)

    kinds = dict(df.dtypes)
    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{name}` array<int>"]))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), "text", "ids", ["doc_id"], f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
