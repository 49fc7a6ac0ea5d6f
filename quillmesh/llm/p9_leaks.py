"""Problem 9: passages of test items inside the documents of a corpus.

Both sides become sequences of word hashes. A fixed mask of a span of ``run`` words keeps some places of a window and
ignores the others (a spaced seed); windows of a test item and of a document that agree in the kept places have the same
seed hash. Seeds of the corpus are joined with those of the items and every hit is verified: around it the two
sequences are laid over each other, and the longest unbroken agreement, and the longest that bears substitutions, are
taken. Every window of ``run`` equal words is a hit, whatever the mask, so :func:`leaks` misses no exact run. Stretches
with substitutions have masks of their own, of which each such stretch holds at least one, so it misses none of these either.

The items' seeds are broadcast while they are at most ``broadcast_bytes`` large, which is checked first; beyond that only a
bitmap of them is, which clears most of the corpus where it is read. What it leaves is joined by hash in the cluster, with
the seeds that turn out frequent salted, and only documents that met an item send their texts.

Defined results: null, empty and short texts on either side give no rows; repeated rows give each pair once; ties
between alignments go to the longest agreement, then the most agreeing words. Texts are read whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.components import salted
from quillmesh.llm.plain import hash_words, words
from quillmesh.llm.wordsets import bitmap_of, in_bitmap
from quillmesh.runtime import cut, map_batches, table

#: Fixed masks over a span of ten words; each keeps the ends.
MASKS = ("1110110111", "1101011011")
#: Masks for stretches of ten words or more of which at most a fifth are substituted. Of two pieces of a stretch one bears no
#: larger share than the whole, so each holds a piece of 10 to 19 words with at most a fifth substituted; every pattern of such
#: a piece agrees with one of these masks somewhere (found by greedy covering of all 4,655 patterns; a test counts them again).
TOLERANT_MASKS = ("1111011", "110010111", "1110100011", "1011111", "1110111", "111100101")
#: Equal-word flags laid out at once.
FLAGS = 1 << 22
BROADCAST_BYTES = 64 << 20


def _mixers(mask: str) -> list[tuple[int, np.uint64]]:
    """The kept places of a mask, each with its odd factor."""
    rng = np.random.default_rng(int(mask, 2))
    return [(i, np.uint64(int(rng.integers(1, 2**63)) * 2 + 1)) for i, kept in enumerate(mask) if kept == "1"]


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash of every window of a sequence."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, factor in _mixers(mask):
        out += hashes[i : i + n] * factor
    return out ^ out >> np.uint64(29)


class Items:
    """The word hashes of all test items after one another, and their seeds in order."""

    def __init__(self, ids: list[int], texts: list[str | None], masks: tuple[str, ...] = MASKS):
        found = [words(t) for t in texts]
        self.ids, self.masks = np.array(ids, np.int64), masks
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = hash_words([w for x in found for w in x])
        self.tables = []
        for mask in masks:
            rows = [(seeds(self.hashes[s : s + m], mask), np.full(max(0, m - len(mask) + 1), k), np.arange(max(0, m - len(mask) + 1))) for k, (s, m) in enumerate(zip(self.starts, self.sizes, strict=True))]
            seed, item, place = (np.concatenate([r[i] for r in rows]) if rows else np.empty(0, kind) for i, kind in enumerate((np.uint64, np.int64, np.int64)))
            order = np.argsort(seed, kind="stable")
            self.tables.append((seed[order], item[order], place[order]))
        self.bloom = np.zeros(1 << 22, bool)
        for seed, _, _ in self.tables:
            self.bloom[(seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``hashes``, item, place in the item, span) of every seed the two share."""
        out = []
        for mask, (seed, item, place) in zip(self.masks, self.tables, strict=True):
            own = seeds(hashes, mask)
            at = np.flatnonzero(self.bloom[(own & np.uint64((1 << 22) - 1)).astype(np.int64)])
            low, high = np.searchsorted(seed, own[at], "left"), np.searchsorted(seed, own[at], "right")
            n = high - low
            k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(at, n), item[k], place[k], np.full(len(k), len(mask))))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def agreement(doc: np.ndarray, item: np.ndarray, shift: int, least_share: float = 0.8) -> tuple[int, int, int]:
    """With item word ``i`` over document word ``i + shift``: the longest unbroken run of equal words, and length and
    equal words of the longest stretch that begins and ends with equal words and holds at least ``least_share`` of them."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[low + shift : high + shift] == item[low:high]
    if not equal.any():
        return 0, 0, 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    unbroken = int((edges[1::2] - edges[::2]).max())
    at = np.flatnonzero(equal)
    # score = equal - least_share * length; a stretch from i to j qualifies when its score is not negative
    score = np.cumsum(equal - least_share)
    before = np.concatenate([[0.0], score])[at]
    lowest = np.minimum.accumulate(before)
    first = np.searchsorted(-lowest, -score[at] - 1e-9, "left")
    lengths = at - at[np.minimum(first, len(at) - 1)] + 1
    best = int(lengths.argmax())
    return unbroken, int(lengths[best]), int(best - min(first[best], len(at) - 1) + 1)


def _dense(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: Items, seen: np.ndarray, run: int) -> np.ndarray:
    """Which of ``seen`` (document, item, shift) hold ``run`` words or more in a row of which at most a fifth differ."""
    out = np.zeros(len(seen), bool)
    order = np.argsort(items.sizes[seen[:, 1]], kind="stable")  # so that rows of like width go together
    at = 0
    while at < len(order):
        most = max(1, FLAGS // max(1, int(items.sizes[seen[order[at], 1]])))
        width = int(items.sizes[seen[order[min(at + most, len(order)) - 1], 1]])
        rows = order[at : at + max(1, min(most, FLAGS // max(1, width)))]
        at += len(rows)
        doc, item, shift = seen[rows].T
        width = int(items.sizes[item].max())
        i = np.arange(width)
        there = i + shift[:, None]
        inside = (i < items.sizes[item][:, None]) & (there >= 0) & (there < sizes[doc][:, None])
        own = hashes[np.where(inside, starts[doc][:, None] + there, 0)]
        other = items.hashes[np.where(inside, items.starts[item][:, None] + i, 0)]
        sums = np.zeros((len(rows), width + 1), np.int32)
        np.cumsum(np.where(inside & (own == other), 1, -4), axis=1, out=sums[:, 1:])
        if width >= run:
            out[rows] = (sums[:, run:] >= np.minimum.accumulate(sums, axis=1)[:, : width + 1 - run]).any(axis=1)
    return out


def _overlaps(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: Items, run: int, tolerant: bool) -> tuple[list, list, list, list, list]:
    """Verified overlaps of a batch: document, item, unbroken run, stretch, equal words."""
    place, item, at, span = items.hits(hashes)
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    if not len(place):
        return out
    doc = np.searchsorted(starts, place, "right") - 1
    while True:  # empty documents start where the next one does
        back = sizes[doc] == 0
        if not back.any():
            break
        doc = np.where(back, doc - 1, doc)
    inside = place - starts[doc] + span <= sizes[doc]
    doc, item, shift = doc[inside], item[inside], (place - starts[doc])[inside] - at[inside]
    order = np.lexsort((shift, item, doc))
    seen = np.stack([doc, item, shift], axis=1)[order]
    seen = seen[np.concatenate([[True], (seen[1:] != seen[:-1]).any(axis=1)])] if len(seen) else seen
    if tolerant:
        seen = seen[_dense(hashes, starts, sizes, items, seen, run)]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, k, s in seen.tolist():
        own = hashes[starts[d] : starts[d] + sizes[d]]
        found = agreement(own, items.hashes[items.starts[k] : items.starts[k] + items.sizes[k]], s)
        if found[0] >= run or tolerant and found[1] >= run:
            best[d, k] = max(best.get((d, k), (0, 0, 0)), found)
    for (d, k), (unbroken, stretch, equal) in best.items():
        for column, v in zip(out, (ids[d], items.ids[k], unbroken, stretch, equal), strict=True):
            column.append(v)
    return out


_SCHEMA = "doc_id bigint, item_id bigint, unbroken bigint, stretch bigint, equal_words bigint"


def leaks(docs: DataFrame, items: DataFrame, run: int = 10, tolerant: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and an item that leaked into it.

    ``docs`` holds doc_id and text, ``items`` item_id and text. With ``tolerant``, stretches of at least ``run`` words with
    at most a fifth of them substituted, which begin and end with equal words, count too; all of them are found.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").where(F.length("text") > 0)
    size = items.agg(F.coalesce(F.sum(F.length("text") + F.lit(16)), F.lit(0))).first()[0] * 8
    if size > broadcast_bytes:
        return _joined(docs, items, run, tolerant)
    rows = items.dropDuplicates(["item_id", "text"]).collect()  # bounded: its size was checked
    if not rows:
        return spark.createDataFrame([], _SCHEMA)
    sent = spark.sparkContext.broadcast(pickle.dumps(Items([r[0] for r in rows], [r[1] for r in rows], TOLERANT_MASKS if tolerant else MASKS)))
    holder: list[Items] = []

    def run_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(pickle.loads(sent.value))
        found = [words(t) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(w) for w in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = hash_words([w for x in found for w in x])
        out = _overlaps(batch.column(0).to_numpy(zero_copy_only=False), hashes, starts, sizes, holder[0], run, tolerant)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "unbroken", "stretch", "equal_words"])

    found = map_batches(docs.filter(F.length("text") > 0), run_batch, _SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max("unbroken").alias("unbroken"), F.max("stretch").alias("stretch"), F.max("equal_words").alias("equal_words"))


def _joined(docs: DataFrame, items: DataFrame, run: int, tolerant: bool) -> DataFrame:
    """The same where the items are too large to broadcast: seeds are joined by hash, then only the texts that met are laid over each other."""
    masks = TOLERANT_MASKS if tolerant else MASKS

    def explode(known: np.ndarray | None, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out_id, out_seed = batch.column(0).to_pylist(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, t in zip(ids, batch.column(1).to_pylist(), strict=True):
            h = hash_words(words(t))
            s = np.unique(np.concatenate([seeds(h, m) for m in masks]))
            s = s if known is None else s[in_bitmap(known, s)]
            out_id.append(np.full(len(s), k, np.int64))
            out_seed.append(s.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_seed))], names=["k", "seed"])

    send = docs.sparkSession.sparkContext.broadcast
    docs = docs.filter(F.length("text") > 0)
    right = cut(map_batches(items, lambda batch: explode(None, batch), "k bigint, seed bigint").withColumnRenamed("k", "item_id").distinct())
    item_seeds = right.select("seed").distinct()
    known = send(bitmap_of(item_seeds, item_seeds.count()))  # at most 64 MB
    left = cut(map_batches(docs, lambda batch: explode(known.value, batch), "k bigint, seed bigint").withColumnRenamed("k", "doc_id"))
    met = cut(salted(left, right, "seed", "doc_id", left.count()).select("doc_id", "item_id").distinct())
    hit_ids = met.select("doc_id").distinct()
    hit = send(bitmap_of(hit_ids, hit_ids.count()))
    own = map_batches(docs.where("doc_id IS NOT NULL"), lambda batch: batch.filter(pa.array(in_bitmap(hit.value, batch.column(0).to_numpy()))), "doc_id bigint, text string")
    pairs = met.join(own.dropDuplicates(["doc_id", "text"]), "doc_id").withColumnRenamed("text", "doc").join(items.dropDuplicates(["item_id", "text"]), "item_id").select("doc_id", "item_id", "doc", "text")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for d, k, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = words(doc)
            part = _overlaps(np.array([d]), hash_words(own), np.array([0]), np.array([len(own)]), Items([k], [text], masks), run, tolerant)
            for column, v in zip(out, part, strict=True):
                column.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "unbroken", "stretch", "equal_words"])

    return map_batches(pairs, verify, _SCHEMA).groupBy("doc_id", "item_id").agg(F.max("unbroken").alias("unbroken"), F.max("stretch").alias("stretch"), F.max("equal_words").alias("equal_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which at least ten consecutive words stand in them: of all overlaps, which may bear
    substitutions, those with an unbroken run of ten."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tolerant=True)
    return found.where("unbroken >= 10").select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps, substituted words allowed, with their lengths."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tolerant=True)
