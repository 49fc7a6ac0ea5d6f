"""Sets of words as sorted hashes, and how rare each word is over all records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.plain import hash_words, words
from quillmesh.runtime import map_batches

#: Buckets of the rarity table: 8 MB of one-byte levels, whatever the size of the corpus.
BITS = 23
_CHUNKS = 64


def split_rows(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every element of concatenated rows, and where each row starts."""
    return np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes


def binary_rows(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a binary column of packed numbers, concatenated, and how many each row has."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), np.diff(offsets).astype(np.int64) // width


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The inverse of :func:`binary_rows`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def sets_of(texts: list[str | None], joined: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts (each with the words of ``joined`` added): total words, the hashes of the distinct words of all texts
    after one another, how many each has, and a 64-bit hash of each set."""
    found = [words(t) for t in texts] if joined is None else [words(t) + words(u) for t, u in zip(texts, joined, strict=True)]
    total = np.fromiter(map(len, found), np.int64, len(found))
    found = [list(dict.fromkeys(x)) for x in found]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    hashes = hash_words([w for x in found for w in x])
    row, _ = split_rows(hashes, sizes)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros(len(found), np.uint64)
    np.add.at(sums, row, mixed ^ mixed >> np.uint64(29))
    return total, hashes, sizes, sums.view(np.int64)


def word_sets(df: DataFrame, keep: list[str], text: str, also: str | None = None, kind: type = np.uint64) -> DataFrame:
    """Columns ``keep``, and n_words, n (distinct), set_hash, and the distinct word hashes packed as ``toks``.

    Null texts have no words. With ``kind`` uint32 the upper half of each hash is kept, one for each distinct word.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index
        total, hashes, sizes, sums = sets_of(batch.column(at(text)).to_pylist(), batch.column(at(also)).to_pylist() if also else None)
        if kind is np.uint32:
            hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        new = [pa.array(total.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(sums), packed(hashes, sizes)]
        return pa.RecordBatch.from_arrays([*batch.select(keep).columns, *new], names=[*keep, "n_words", "n", "set_hash", "toks"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_words int, n int, set_hash bigint, toks binary"])
    return map_batches(df.select(*dict.fromkeys([*keep, text, *([also] if also else [])])), run, schema)


def bucket_of(toks: np.ndarray) -> np.ndarray:
    """The bucket of each word hash."""
    shift = 32 if toks.dtype == np.uint64 else 0
    return (toks >> toks.dtype.type(shift) & toks.dtype.type((1 << BITS) - 1)).astype(np.int64)


def rarity(sets: DataFrame, kind: type = np.uint64, column: str = "toks", codes: str | None = None, spelled: np.ndarray | None = None) -> np.ndarray:
    """For each bucket of word hashes a level that grows with the number of records that hold a word of it.

    Every record counts. Level 0 means at most one record, so a word of such a bucket is in no second one. What each task
    sends are the buckets it met; the sum is a table of fixed size. ``codes`` may name a column of bytes that stand for the
    hashes ``spelled``.
    """

    def tally(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        sums += np.bincount(bucket_of(binary_rows(batch.column(0), kind)[0]), minlength=1 << BITS)
        if codes:
            uses = np.bincount(binary_rows(batch.column(1), np.uint8)[0], minlength=len(spelled))
            np.add.at(sums, bucket_of(spelled), uses)

    return bucket_levels(sets.select(column, *([codes] if codes else [])), tally, 1)


def bucket_levels(rows: DataFrame, tally: Callable[[pa.RecordBatch, np.ndarray], None], none: int) -> np.ndarray:
    """A level for each bucket that grows with the number that ``tally`` adds to it over all batches; 0 up to ``none``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            tally(batch, sums)
        met = np.flatnonzero(sums)
        part = met * _CHUNKS >> BITS
        edges = np.searchsorted(part, np.arange(_CHUNKS + 1))
        rows = [(c, met[a:b].astype(np.int32).tobytes(), sums[met[a:b]].tobytes()) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "at", "n"])

    def add(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (1 << BITS) // _CHUNKS
        chunk, sums = key[0].as_py(), np.zeros(width, np.int64)
        for batch in groups:
            for at, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[np.frombuffer(at, np.int32) - chunk * width] += np.frombuffer(n, np.int64)
        level = np.where(sums <= none, 0, 1 + 4 * np.log2(np.maximum(sums, 1))).clip(0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    found = rows.mapInArrow(count, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect()
    out = np.zeros(1 << BITS, np.uint8)
    for r in found:
        at = r.chunk * ((1 << BITS) // _CHUNKS)
        out[at : at + (1 << BITS) // _CHUNKS] = np.frombuffer(bytes(r.level), np.uint8)
    return out


def count_of_level(level: np.ndarray) -> np.ndarray:
    """The least number of records that a level stands for."""
    return np.where(level == 0, 1, 2.0 ** ((level.astype(np.float64) - 1) / 4))


def by_rarity(toks: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row, rarest first (ties by hash): row numbers, words, levels. The order is the same in all rows."""
    row, _ = split_rows(toks, sizes)
    level = levels[bucket_of(toks)]
    order = np.lexsort((toks, level, row))
    return row[order], toks[order], level[order]


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    """How many of ``n`` words, rarest first, must hold one that any set of at least ``least`` Jaccard similarity shares."""
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def bitmap_of(df: DataFrame, rows: int, most_bits: int = 1 << 29) -> np.ndarray:
    """A bitmap that has the bit of every hash in the only column of ``df`` (about ``rows`` rows), of at most ``most_bits``."""
    bits = min(most_bits, 1 << int(np.clip(np.ceil(np.log2(16 * max(1, rows))), 16, 40)))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.unique(np.concatenate([b.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1) for b in batches if b.num_rows] or [np.empty(0, np.uint64)]))
        if len(place):
            at, first = np.unique(place >> np.uint64(6), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first).view(np.int64))], names=["at", "bits"])

    out = np.zeros(bits // 64, np.int64)
    for r in df.mapInArrow(marks, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # fewer than the bitmap has words
        out[r[0]] = r[1]
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap; those that it was made of always are."""
    place = hashes.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def same_sets(df: DataFrame, *key: str) -> DataFrame:
    """One row for each distinct word set: the least of each other column by the key."""
    return df.groupBy(*key, "set_hash").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
