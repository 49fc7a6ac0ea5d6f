"""Problem 5: families of records that differ by small edits.

Two records are linked when their word sets have a Jaccard similarity of at least ``least``; a family is everything
linked. The search runs in groups of records that share a rare word (the rarest word that two linked sets share is one of
the rarest ``n - ceil(least * n) + 1`` words of the larger and, as they share at least ``2 * least / (1 + least)`` of the
smaller, one of the fewer rarest words of the smaller that this leaves, in an order that all records use), so no group sees
the whole collection, and two records that both hold its word beyond these fewer are not compared there. In
each group the records are leaves of a signature tree: a node holds the OR of its records' word bitmaps and the range of
their sizes. Two trees, or one and itself, are walked from the roots down together, and a pair of nodes is left as soon as
its bitmaps or sizes leave no room for the overlap asked for. Pairs of records that come through are verified on words.
Pairs whose records are in one component already are left too, so a family of any density costs few verifications.

Copies are one class from the start. Of words that many records hold it is counted how many have them among the fewer
rarest, in a table of fixed size: where none has, the word gives no group, however many records hold it. Where very many
have, it gives not one group but one for each pair of blocks of its records (two blocks of ``BLOCK`` records at most), so
no task holds an unbounded group.

What travels is packed: the ``COMMON`` words that are most frequent in a sample are one byte each (the sample decides on
their spelling alone), all others 24 bits of their hash, words of no second record only count, and a record is sent once
to each partition that holds groups of it. Within groups the overlap of common words is exact in the bitmaps. Two other
words agree in 24 bits by chance once in 16 million, so every link that comes out is verified on the whole 64-bit hashes of
both sets, as in problem 2; where one proves false, its component is linked again by other bits.

Defined results: null and short texts (fewer than ``least_words`` words) belong to no family; repeated deliveries are
one record; a word counts once in a set however often it stands in the text; order of words does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import fields
from quillmesh.llm.components import components, look_up
from quillmesh.llm.plain import hash_words, words
from quillmesh.llm.wordsets import BITS, binary_rows, bitmap_of, bucket_levels, bucket_of, count_of_level, in_bitmap, packed, prefix_length, rarity, sets_of, split_rows
from quillmesh.runtime import cut, default_parallelism, map_batches, release, sampled, whole_groups

#: Records of one word that form a block, as estimated from the table of its postings.
BLOCK = 16_384
#: Records of a word from which its postings are counted, and the bits of the table: half of its cells for each role.
HEAVY, CELL_BITS = 256, BITS - 1
LEAF, FAN = 16, 8
#: Words that are spelled in one byte, and the texts that they are counted in.
COMMON, SAMPLE = 255, 4_000
#: Word sets that a task remembers in order to send copies once.
SEEN = 1_000_000
#: Words of a record that stand in the matrix.
WIDE = 32
_LANES = 4  # 64-bit lanes of a bitmap, for common words and again for the others


def _bits(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bitmap of 256 bits for each row of numbers below 256."""
    maps, begin = [np.empty((0, 4), np.uint64)], np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), 50_000):
        b = min(len(sizes), a + 50_000)
        out = np.zeros((b - a, 256), bool)
        out[np.repeat(np.arange(b - a), sizes[a:b]), flat[begin[a] : begin[b]]] = True
        maps.append(np.packbits(out, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(maps)


class Sets:
    """Word sets of some records: bitmaps of common words, bitmaps and a padded matrix of the others, and sizes."""

    def __init__(self, n: np.ndarray, flat: np.ndarray, sizes: np.ndarray, common: np.ndarray, common_sizes: np.ndarray, tags: np.ndarray | None = None):
        self.n = n.astype(np.int32)
        row, begin = split_rows(flat, sizes)
        place = np.arange(len(flat)) - begin[row]
        width = int(min(WIDE, sizes.max(initial=1)))
        # short rows stand in a matrix, all that is longer is found by search, so one long record widens nothing
        self.words = np.zeros((len(sizes), width), np.uint32)
        inside = place < width
        self.words[row[inside], place[inside]] = flat[inside]
        self.filled = np.arange(width)[None, :] < sizes[:, None]
        self.flat, self.begin = flat, begin
        self.sorted = np.sort(row.astype(np.uint64) << np.uint64(32) | flat) if sizes.max(initial=0) > WIDE else None
        bit = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
        rare = _bits(bit.astype(np.int64), sizes)
        self.slack = sizes.astype(np.int32) - np.bitwise_count(rare).sum(axis=1).astype(np.int32)
        self.sizes = sizes
        self.tags = np.zeros(len(n), np.uint16) if tags is None else tags  # records of two sources are never linked
        self.maps = np.concatenate([_bits(common, common_sizes), rare], axis=1)

    def similar(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Which of the pairs (i, j) reach the similarity, bitmaps first."""
        ni, nj = self.n[i], self.n[j]
        need = np.ceil(least / (1 + least) * (ni + nj) - 1e-9)
        met = np.bitwise_count(self.maps[i] & self.maps[j]).astype(np.int32)
        common = met[:, :_LANES].sum(axis=1)
        room = common + np.minimum(met[:, _LANES:].sum(axis=1) + np.minimum(self.slack[i], self.slack[j]), np.minimum(self.sizes[i], self.sizes[j]))
        go = np.flatnonzero((room >= need) & (self.tags[i] == self.tags[j]) & (np.minimum(ni, nj) >= least * np.maximum(ni, nj) - 1e-9))
        out = np.zeros(len(i), bool)
        wide = np.maximum(self.sizes[i[go]], self.sizes[j[go]]) > WIDE
        for start in range(0, int(wide.sum()), 4096):
            k = go[wide][start : start + 4096]
            shared = common[k] + self._searched(i[k], j[k])
            out[k] = shared >= least * (ni[k] + nj[k] - shared) - 1e-9
        go = go[~wide]
        step = max(1, 8_000_000 // max(1, self.words.shape[1] ** 2))
        for start in range(0, len(go), step):
            k = go[start : start + step]
            wa, wb = max(1, int(self.sizes[i[k]].max())), max(1, int(self.sizes[j[k]].max()))
            a, b = self.words[i[k], :wa], self.words[j[k], :wb]
            equal = a[:, :, None] == b[:, None, :]
            equal &= self.filled[i[k], :wa, None] & self.filled[j[k], None, :wb]
            shared = common[k] + equal.any(axis=2).sum(axis=1)
            out[k] = shared >= least * (ni[k] + nj[k] - shared) - 1e-9
        return out


    def _searched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shared words of pairs: those of the smaller record are looked up in the larger, some hundred thousand at a time."""
        small, large = np.where(self.sizes[i] <= self.sizes[j], i, j), np.where(self.sizes[i] <= self.sizes[j], j, i)
        out, size = np.zeros(len(i), np.int64), self.sizes[small]
        total = np.cumsum(size)
        start = 0
        while start < len(i):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 400_000, "right")))
            row, _ = split_rows(small[start:end], size[start:end])
            at = np.arange(len(row)) - np.repeat(np.cumsum(size[start:end]) - size[start:end], size[start:end])
            sought = large[start:end][row].astype(np.uint64) << np.uint64(32) | self.flat[self.begin[small[start:end][row]] + at]
            place = np.minimum(np.searchsorted(self.sorted, sought), len(self.sorted) - 1)
            out[start:end] = np.bincount(row, self.sorted[place] == sought, minlength=end - start)
            start = end
        return out


class Forest:
    """Union-find over the records at hand, in one array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The roots of some records, or of all."""
        found = self.parent if rows is None else self.parent[rows]
        while True:
            up = self.parent[found]
            if (up == found).all():
                break
            found = up
        if rows is not None:
            self.parent[rows] = found
        return found

    def link(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins pairs; returns those that joined two components when taken in turn."""
        kept, parent = [], self.parent
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append(k)
        return i[kept], j[kept]


def tree_links(sets: Sets, rows: np.ndarray, forest: Forest, least: float, leads: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among ``rows``, enough to join all that are linked, by a dual walk of their signature tree. Pairs without a row
    that ``leads`` are not looked at; without it all do."""
    leads = np.ones(len(rows), bool) if leads is None else leads
    order = rows[np.lexsort((*sets.words[rows, : min(4, sets.words.shape[1])].T[::-1], sets.n[rows], ~leads))]
    leading = int(leads.sum())  # these stand in front, so the first of two rows tells
    # the lowest level are leaves of LEAF records, each further one nodes of FAN
    bounds = [np.arange(0, len(order), LEAF)]
    levels = []
    maps, low, high, slack = sets.maps[order], sets.n[order], sets.n[order], sets.slack[order]
    while True:
        at = bounds[-1]
        maps, low, high, slack = np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)
        levels.append((maps, low, high, slack))
        if len(at) == 1:
            break
        bounds.append(np.arange(0, len(at), FAN))

    def open_pairs(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maps, low, high, slack = levels[level]
        need = np.ceil(least / (1 + least) * (low[a].astype(np.int64) + low[b]) - 1e-9)
        room = np.minimum(np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int32) + np.minimum(slack[a], slack[b]), np.minimum(high[a], high[b]))
        go = (room >= need) & (high[b] >= least * low[a] - 1e-9) & (high[a] >= least * low[b] - 1e-9) & (a * (LEAF * FAN**level) < leading)
        return a[go], b[go]

    a = b = np.zeros(1, np.int64)
    for level in range(len(levels) - 1, 0, -1):
        a, b = open_pairs(level, a, b)
        children = len(levels[level - 1][1])
        ca, cb = (np.minimum(x[:, None] * FAN + np.arange(FAN), children) for x in (a, b))
        pa_, pb_ = np.repeat(ca, FAN, axis=1).ravel(), np.tile(cb, (1, FAN)).ravel()
        go = (pa_ < children) & (pb_ < children) & (pa_ <= pb_)
        pairs = np.unique(pa_[go] * children + pb_[go])
        a, b = pairs // children, pairs % children
    a, b = open_pairs(0, a, b)
    first = np.argsort(b - a, kind="stable")  # leaves with themselves and with near ones come first
    a, b = a[first], b[first]
    found = []
    n, start, step = len(order), 0, 64
    own_maps, own_n, own_slack = sets.maps[order], sets.n[order].astype(np.int64), sets.slack[order]
    leaf_maps, leaf_low, leaf_high, _ = levels[0]
    within = np.arange(LEAF)

    def fit(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Which of the records in ``rows`` (a line for each leaf) may be similar to any record of the leaf."""
        at = np.minimum(rows, n - 1)
        size = own_n[at]
        low, high = leaf_low[leaf][:, None].astype(np.int64), leaf_high[leaf][:, None].astype(np.int64)
        need = np.ceil(least / (1 + least) * (size + low) - 1e-9)
        room = np.minimum(np.bitwise_count(own_maps[at] & leaf_maps[leaf][:, None, :]).sum(axis=2, dtype=np.int32) + own_slack[at], high)
        return (rows < n) & (room >= need) & (high >= least * size - 1e-9) & (size >= least * low - 1e-9)

    while start < len(a):
        x, y = a[start : start + step], b[start : start + step]
        start, step = start + step, min(step * 2, 4096)
        rows_x, rows_y = x[:, None] * LEAF + within, y[:, None] * LEAF + within
        open_x, open_y = fit(rows_x, y), fit(rows_y, x)
        roots = forest.roots(order)
        root_x, root_y = roots[np.minimum(rows_x, n - 1)], roots[np.minimum(rows_y, n - 1)]
        go = open_x[:, :, None] & open_y[:, None, :] & (root_x[:, :, None] != root_y[:, None, :]) & (rows_x[:, :, None] < rows_y[:, None, :]) & (rows_x[:, :, None] < leading)
        p, i, j = np.nonzero(go)
        i, j = order[rows_x[p, i]], order[rows_y[p, j]]
        hit = sets.similar(i, j, least)
        found.append(forest.link(i[hit], j[hit]))
    return found


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each of many small groups of consecutive rows."""
    i_all, j_all = [], []
    for size in np.unique(sizes).tolist():
        if size > 1:
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size][:, None]
            i_all.append((at + i).ravel())
            j_all.append((at + j).ravel())
    if not i_all:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(i_all), np.concatenate(j_all)


def links_of_groups(key: np.ndarray, of: np.ndarray, leads: np.ndarray, sets: Sets, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups: record ``of[i]`` of ``sets`` stands in group ``key[i]``, once, and ``leads`` or does not; keys ascend."""
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    forest, found = Forest(len(sets.n)), []
    small = sizes <= LEAF
    i, j = _small_pairs(starts[small], sizes[small])
    go = leads[i] | leads[j]
    i, j = of[i[go]], of[j[go]]
    if len(i):
        pairs = np.unique(np.minimum(i, j) * len(sets.n) + np.maximum(i, j))
        i, j = pairs // len(sets.n), pairs % len(sets.n)
        i, j = i[i != j], j[i != j]
        hit = np.concatenate([sets.similar(i[k : k + 200_000], j[k : k + 200_000], least) for k in range(0, len(i), 200_000)] or [np.empty(0, bool)])
        found.append(forest.link(i[hit], j[hit]))
    for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        found += tree_links(sets, of[s : s + m], forest, least, leads[s : s + m])
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def common_words(records: DataFrame, text: str) -> np.ndarray:
    """Hashes of the words that most of a few thousand texts hold, in ascending order."""
    from collections import Counter

    counts: Counter = Counter()
    for r in sampled(records.select("id", text).where(F.length(text) > 0), "id", SAMPLE, 11).select(text).collect():
        counts.update(set(words(r[0])))
    return np.sort(hash_words([w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]))


def _records(df: DataFrame, common: np.ndarray, least_words: int) -> DataFrame:
    """(src, id, space, set_hash, n, rare, common) of the records with enough words; set hashes of two sources differ."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, hashes, sizes, sums = sets_of(batch.column(2).to_pylist())
        row, _ = split_rows(hashes, sizes)
        at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
        known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
        codes = np.bincount(row[known], minlength=len(sizes))
        space = batch.column(3).to_numpy()
        new = [
            batch.column(3), pa.array(sums ^ space), pa.array(sizes.astype(np.int32)),
            packed(hashes[~known], sizes - codes), packed(at[known].astype(np.uint8), codes),
        ]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["src", "id", "space", "set_hash", "n", "rare", "common"])
        return out.filter(pa.array(total >= least_words))

    return map_batches(df.select("src", "id", "text", F.xxhash64("src").alias("space")), run, "src string, id string, space bigint, set_hash bigint, n int, rare binary, common binary")


_BLOB = "part int, keys binary, of binary, hashes binary, tags binary, n binary, sizes binary, rare binary, common_sizes binary, common binary"
#: Records of one piece, so that 16 bits tell them apart.
PIECE = 50_000


def _postings(levels: np.ndarray, spelled: np.ndarray, n: np.ndarray, rare: tuple[np.ndarray, np.ndarray], codes: tuple[np.ndarray, np.ndarray], least: float) -> tuple:
    """The other words of records and the common ones, rarest first, and the words by which a record meets others: (words,
    their rows and levels), (codes, their rows), (words, rows, levels, whether it leads there)."""
    (rare, sizes), (codes, code_sizes) = rare, codes
    # rare words first, rarest of all in front, then common ones likewise: the same order in all records
    row = np.repeat(np.arange(len(n)), sizes)
    level = levels[bucket_of(rare)]
    order = np.lexsort((rare, level, row))
    rare, level, row = rare[order], level[order], row[order]
    prefix, lead = prefix_length(n, least), prefix_length(n, 2 * least / (1 + least))
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    post = (place < prefix[row]) & (level > 0)
    code_row = np.repeat(np.arange(len(n)), code_sizes)
    codes = codes[np.lexsort((codes, levels[bucket_of(spelled)][codes], code_row))]
    code_place = sizes[code_row] + np.arange(len(code_row)) - np.repeat(np.cumsum(code_sizes) - code_sizes, code_sizes)
    code_post = code_place < prefix[code_row]
    spelled_codes = spelled[codes[code_post]]
    who = np.concatenate([row[post], code_row[code_post]])
    held = np.concatenate([level[post], levels[bucket_of(spelled_codes)]])
    leads = np.concatenate([place[post], code_place[code_post]]) < lead[who]
    return (rare, row, level), (codes, code_row), (np.concatenate([rare[post], spelled_codes]), who, held, leads)


def _heavy(held: np.ndarray) -> np.ndarray:
    return count_of_level(held) >= HEAVY


def _cell(word: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The cell of a heavy word of a source in the table of postings."""
    mixed = word * np.uint64(0xD6E8FEB86659FD93) + space.view(np.uint64)
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def meetings(records: DataFrame, common: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """For each cell of heavy words a level of the records that lead by a word of it, and one of the others that hold it in
    front; 0 is none."""
    sent = records.sparkSession.sparkContext.broadcast((levels, common))  # of fixed size

    def tally(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        space, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        _, _, (word, who, held, leads) = _postings(*sent.value, n, binary_rows(batch.column(2), np.uint64), binary_rows(batch.column(3), np.uint8), least)
        go = _heavy(held)
        np.add.at(sums, _cell(word[go], space[who[go]]) * 2 + ~leads[go], 1)

    return bucket_levels(records.select("space", "n", "rare", "common"), tally, 0).reshape(-1, 2)


def _met(table: np.ndarray, word: np.ndarray, space: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting the numbers of blocks of the records that lead by its word and of the others; no block of the first
    where none does, or but one record holds the word in front."""
    first, other = np.ones(len(word), np.int64), np.ones(len(word), np.int64)
    go = np.flatnonzero(_heavy(held))
    own = table[_cell(word[go], space[go])]
    blocks = np.where(own == 0, 0, np.ceil(count_of_level(own) / BLOCK)).astype(np.int64)
    first[go] = np.where((own[:, 0] == 1) & (own[:, 1] == 0), 0, blocks[:, 0])
    other[go] = np.maximum(1, blocks[:, 1])
    return first, other


def _pairs_of_blocks(hashes: np.ndarray, leads: np.ndarray, first: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of postings, as their places and the pair of blocks that each group is of.

    Records that lead meet each other and all others: a group for each pair of blocks. Where there is but one block of them,
    they meet each other beside the others.
    """
    each = np.where(first == 0, 0, np.where(leads, other + np.where(first > 1, first, 0), first))
    at = np.repeat(np.arange(len(each)), each)
    own = (hashes.view(np.uint64) % np.maximum(1, np.where(leads, first, other)).astype(np.uint64)).astype(np.int64)[at]
    k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    leads, first, other = leads[at], first[at], other[at]
    across = k < other
    one = np.where(leads, np.where(across, own, np.minimum(own, k - other)), k)
    two = np.where(leads, np.where(across, first + k, np.maximum(own, k - other)), first + own)
    return at, one * (first + other) + two


def _placed(records: DataFrame, common: np.ndarray, levels: np.ndarray, least: float, parts: int, slice_: int = 0) -> DataFrame:
    """Records and the groups that they stand in, packed by the partition of the groups. ``slice_`` tells which 24 bits of a
    word's hash stand for it."""
    low = np.uint64(40 - 20 * slice_)
    sent = records.sparkSession.sparkContext.broadcast((levels, common, meetings(records, common, levels, least)))  # of fixed size
    seen: set[int] = set()

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        tables = [t for i in range(0, batch.num_rows, PIECE) if (t := place(batch.slice(i, PIECE)))]
        return pa.concat_tables(tables) if tables else None

    def place(batch: pa.RecordBatch) -> pa.Table | None:
        levels, spelled, table = sent.value
        hashes, space, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
        if len(seen) > SEEN:
            seen.clear()
        fresh = np.fromiter((h not in seen and not seen.add(h) for h in hashes.tolist()), bool, len(hashes))
        if not fresh.any():
            return None
        batch = batch.filter(pa.array(fresh))
        hashes, space, n = hashes[fresh], space[fresh], n[fresh].astype(np.int64)
        codes = binary_rows(batch.column(4), np.uint8)
        code_sizes = codes[1]
        (rare, row, level), (codes, code_row), (word, who, held, leads) = _postings(levels, spelled, n, binary_rows(batch.column(3), np.uint64), codes, least)
        first, other = _met(table, word, space[who], held)
        at, pair = _pairs_of_blocks(hashes[who], leads, first, other)
        word, who, leads = word[at], who[at], leads[at]
        key = word * np.uint64(0x9E3779B97F4A7C15) + pair.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + space[who].view(np.uint64)
        key ^= key >> np.uint64(29)
        part = (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(parts)
        key = (key >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | leads.astype(np.uint32)  # the last bit tells who leads
        tags = (space.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        # words that no second record holds are sent as part of n alone
        shared = level > 0
        rare, sizes = rare[shared], np.bincount(row[shared], minlength=len(n)).astype(np.int64)
        begin, code_begin = np.cumsum(sizes) - sizes, np.cumsum(code_sizes) - code_sizes
        order = np.lexsort((key, part))
        key, who, part = key[order], who[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a == b:
                continue
            sub, of = np.unique(who[a:b], return_inverse=True)
            take = np.repeat(begin[sub], sizes[sub]) + np.arange(sizes[sub].sum()) - np.repeat(np.cumsum(sizes[sub]) - sizes[sub], sizes[sub])
            code_take = np.repeat(code_begin[sub], code_sizes[sub]) + np.arange(code_sizes[sub].sum()) - np.repeat(np.cumsum(code_sizes[sub]) - code_sizes[sub], code_sizes[sub])
            three = np.ascontiguousarray((rare[take] >> low).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3])
            rows.append((p, key[a:b].tobytes(), of.astype(np.uint16).tobytes(), hashes[sub].tobytes(), tags[sub].tobytes(), n[sub].astype(np.uint32).tobytes(), sizes[sub].astype(np.uint32).tobytes(), three.tobytes(), code_sizes[sub].astype(np.uint8).tobytes(), codes[code_take].tobytes()))
        if not rows:
            return None
        names = [c.split(" ")[0] for c in _BLOB.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(10)], names=names)

    return map_batches(records.select("set_hash", "space", "n", "rare", "common"), run, _BLOB)


def links_of_pieces(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between word sets from the pieces of one partition."""
    kinds = (np.uint32, np.uint16, np.int64, np.uint16, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8)
    keys, of, hashes, tags, n, sizes, three, common_sizes, codes = ([np.frombuffer(x, kind) for x in table.column(i + 1).to_pylist()] for i, kind in enumerate(kinds))
    shift = np.cumsum([0, *map(len, hashes)])
    of = np.concatenate([o.astype(np.int64) + s for o, s in zip(of, shift[:-1], strict=True)])
    keys, hashes, tags, n, sizes, three, common_sizes, codes = (np.concatenate(c) for c in (keys, hashes, tags, n, sizes, three, common_sizes, codes))
    rare = np.concatenate([three.reshape(-1, 3), np.zeros((len(three) // 3, 1), np.uint8)], axis=1).view(np.uint32).ravel()
    sizes, common_sizes = sizes.astype(np.int64), common_sizes.astype(np.int64)
    unique, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    of = same[of]
    leads, keys = keys & np.uint32(1) == 1, keys >> np.uint32(1)
    order = np.lexsort((~leads, of, keys))
    keys, of, leads = keys[order], of[order], leads[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of, leads = keys[fresh], of[fresh], leads[fresh]
    _, at, count = np.unique(keys, return_index=True, return_counts=True)
    useful = np.repeat((count > 1) & (np.add.reduceat(leads, at, dtype=np.int64) > 0), count) if len(at) else np.zeros(0, bool)
    keys, of, leads = keys[useful], of[useful], leads[useful]
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    used, of = np.unique(of, return_inverse=True)
    pick = first[used]

    def chosen(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, m = (np.cumsum(size) - size)[pick], size[pick]
        return flat[np.repeat(begin, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)], m

    sets = Sets(n[pick], *chosen(rare, sizes), *chosen(codes, common_sizes), tags[pick])
    u, v = links_of_groups(keys, of, leads, sets, least)
    return unique[used][u], unique[used][v]


def links(records: DataFrame, common: np.ndarray, levels: np.ndarray, least: float, slice_: int = 0) -> DataFrame:
    """(u, v): enough links between word sets to join all that are linked, but for words that agree in 24 bits by chance.
    Sources stay apart."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            part = table.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                u, v = links_of_pieces(table.slice(a, b - a), least)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    parts = default_parallelism(records.sparkSession)
    return _placed(records, common, levels, least, parts, slice_).repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(walk, "u bigint, v bigint")


def verified(found: DataFrame, records: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """``found`` (u, v) with whether the whole word hashes of both sets bear it out."""
    nodes = found.select("u").unionAll(found.select(F.col("v").alias("u"))).distinct().select(F.col("u").alias("set_hash"))
    sent = records.sparkSession.sparkContext.broadcast(bitmap_of(nodes, nodes.count()))  # at most 64 MB

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(in_bitmap(sent.value, batch.column(0).to_numpy())))

    sets = map_batches(records.select("set_hash", "space", "n", "rare", "common"), linked, "set_hash bigint, space bigint, n int, rare binary, common binary").dropDuplicates(["set_hash"])
    side = lambda key, x: sets.select(F.col("set_hash").alias(key), F.struct("space", "n", "rare", "common").alias(x))
    both = found.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a.n", "a.rare", "a.common", F.col("b.n").alias("n_"), F.col("b.rare").alias("rare_"), F.col("b.common").alias("common_"), (F.col("a.space") == F.col("b.space")).alias("same"))

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = np.zeros(batch.num_rows, np.int64)
        for i, j, kind in ((3, 6, np.uint64), (4, 7, np.uint8)):
            (x, nx), (y, ny) = binary_rows(batch.column(i), kind), binary_rows(batch.column(j), kind)
            row, both_ = np.concatenate([split_rows(x, nx)[0], split_rows(y, ny)[0]]), np.concatenate([x, y])
            order = np.lexsort((both_, row))
            both_, row = both_[order], row[order]
            shared += np.bincount(row[1:][(both_[1:] == both_[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
        n, m = batch.column(2).to_numpy(), batch.column(5).to_numpy()
        right = (shared >= least * (n + m - shared) - 1e-9) & batch.column(8).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(right)], names=["u", "v", "right"])

    return map_batches(both, check, "u bigint, v bigint, right boolean")


def all_links(records: DataFrame, common: np.ndarray, levels: np.ndarray, least: float) -> DataFrame:
    """(u, v): links that hold on whole words, enough to join all that are linked.

    Where one proves false, the sets of its component are linked again by other bits of their hashes, as what a false link
    joined was not looked at any further.
    """
    whole, left = None, records
    for slice_ in (0, 1, 2):
        found = cut(links(left, common, levels, least, slice_))
        release(records.sparkSession)
        tested = cut(verified(found, left, common, least))
        right = tested.where("right").select("u", "v")
        whole = right if whole is None else whole.unionByName(right)
        if not tested.where("NOT right").limit(1).count():
            break
        roots = components(found)
        torn = tested.where("NOT right").select(F.col("u").alias("node")).join(roots, "node").select("root").distinct()
        again = roots.join(torn, "root", "left_semi").select(F.col("node").alias("set_hash"))
        left = cut(left.join(again, "set_hash", "left_semi"))
    return whole


def families(records: DataFrame, least: float = 0.6, least_words: int = 8) -> DataFrame:
    """(src, id, group_id) of all members of families of two or more; ``records`` holds src, id and text."""
    records = records.where("id IS NOT NULL AND text IS NOT NULL")
    common = common_words(records, "text")
    sets = cut(_records(records, common, least_words))
    levels = rarity(sets, np.uint64, "rare", "common", common)
    release(records.sparkSession)
    found = components(all_links(sets, common, levels, least))
    members = cut(sets.select("src", "id", "set_hash").distinct())
    total = members.count()
    copies = members.groupBy("set_hash").agg(F.count(F.lit(1)).alias("n"))  # one text may be that of many records
    labels = copies.join(found.select(F.col("node").alias("set_hash"), "root"), "set_hash", "left").select("set_hash", F.coalesce("root", "set_hash").alias("label"), "n")
    labelled = cut(look_up(members, "set_hash", labels, "n", total).select("src", "id", "label"))
    named = labelled.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return look_up(labelled, "label", named, "members", total).select("src", "id", "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of messages and of contexts."""
    return families(fields(spark, sf_dir, [("spam_item", "text"), ("decision_example", "state")])).distinct()
