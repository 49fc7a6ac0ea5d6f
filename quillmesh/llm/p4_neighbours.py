"""Problem 4: the k most similar vectors of every vector, by NN-descent.

The first graph comes from ``TREES`` partitions of the space: cells around pivots (fitted on a bounded sample; every
vector is placed), each divided by further pivots of its own members into leaves of at most ``LEAF`` vectors, whose
members are compared. It is rough. Then rounds of NN-descent: at every vector its neighbours and those it is a neighbour
of meet, those that have not met before are compared, and what is better replaces what was known. Only pairs with a new
neighbour are looked at, and none of two that were in one leaf. Rounds go on until fewer than ``UPDATES`` of all list
entries change. Queries from outside enter the graph at the nearest members of the cells they fall into and walk it
greedily (:func:`search`).

A round is four exchanges of packed pieces (one for each batch and part, not one row for each vector). A vector's home
is the part of its cell in the first partition, and cells near each other share a home, so most of a vector's neighbours
live with it and its coordinates travel once to each home that asks for them, not once to each neighbour. After every
round the lists are cut in the checkpoint folder and the files of the round before are let go. Vectors are scaled to
length one and rounded to half precision, which moves a cosine by about 1e-4.

Equal vectors are one node of the graph, so a group of copies of any size stays one row; each copy gets the others with
the least ids, which are ties at similarity 1. Pivots are drawn where vectors are, so dense regions get more cells. Only
where the sample shows a cell of more than ``SHARD`` vectors, which is what a task can hold, is it parted by hash too,
and the rounds bring together what that parts. Of the vectors that have one as a neighbour at most ``MET`` meet there in
one round, new ones first, as the method has it.

Defined results: vectors that are null, empty, zero, of another length than ``dims``, or that hold a null, NaN or
infinity, take no part; where fewer than k others exist all are given; ties go to the smaller id; ids must lie between 0
and 2**62; rows that repeat an id are expected to repeat its vector, else any of them counts; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.components import look_up
from quillmesh.runtime import cut, default_parallelism, map_batches, release, table, whole_groups

TREES = 3
#: Vectors in a cell, on average, and the most pivots of one partition.
CELL, MAX_PIVOTS = 2_000, 16_384
#: Vectors of a leaf, all of which are compared.
LEAF = 256
#: Vectors that one task is given at once; a cell that is estimated to hold more is parted.
SHARD = 1 << 19
#: Neighbours kept for each vector while the graph is built, and how many that have it as a neighbour meet at it in a round.
KEPT, MET = 8, 8
#: Rounds end when a smaller share of all list entries is new; and in any case after so many.
UPDATES, ROUNDS = 0.001, 12
#: Rows whose vectors the pivots are drawn from.
SAMPLE = 16_384
#: Copies that may be broadcast (8 bytes each); beyond that they are joined.
COPIES_SENT = 1_000_000
#: Marks of a list entry: its low bits are the partitions in whose leaves both ends stood.
NEW = 128


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a list column, and these vectors at length one (float32)."""
    column = column.cast(pa.list_(pa.float32()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32)
    right = np.flatnonzero((sizes == dims) & ~np.asarray(column.is_null()))
    rows = flat[column.offsets.to_numpy()[right][:, None] + np.arange(dims)].astype(np.float64) if len(right) else np.empty((0, dims))
    length = np.sqrt((rows**2).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return right[good], (rows[good] / length[good, None] + 0.0).astype(np.float32)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    out = np.full(len(rows), np.uint64(0x243F6A8885A308D3))
    for column in np.ascontiguousarray(rows).view(np.uint32).T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def hashed(df: DataFrame, dims: int) -> DataFrame:
    """(id, hash) of the usable vectors of ``df`` (id, vec)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = unit_rows(batch.column(1), dims)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_hash_rows(rows))], names=["id", "hash"])

    return map_batches(df.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL"), run, "id bigint, hash bigint")


class Nodes:
    """The vectors of a table as nodes: one for each distinct vector, known by its least id."""

    def __init__(self, df: DataFrame, dims: int):
        self.df, self.dims = df.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL"), dims
        ids = cut(hashed(self.df, dims).groupBy("id").agg(F.min("hash").alias("hash")))
        self.rows = ids.count()
        classes = ids.groupBy("hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        self.copies = cut(look_up(ids, "hash", classes, "n", self.rows).select("id", "rep"))
        self.copied = self.copies.count()
        sent = self.df.sparkSession.sparkContext.broadcast
        if self.copied <= COPIES_SENT:  # its size is checked
            known = self.copies.toPandas()
            self.known = sent((np.sort(known.id[known.id != known.rep].to_numpy(np.int64)), np.unique(known.rep.to_numpy(np.int64))))
            self.source = self.df.withColumn("flag", F.lit(None).cast("int"))
        else:
            self.known = None
            marks = self.copies.select("id", F.when(F.col("id") == F.col("rep"), 1).otherwise(-1).alias("flag"))
            self.source = self.df.join(marks, "id", "left").withColumn("flag", F.coalesce("flag", F.lit(0)))

    def mapper(self):
        """A function from a batch of ``source`` to node codes (twice the id, plus one where the node stands for copies) and unit vectors."""
        dims, known = self.dims, self.known

        def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            at = batch.schema.get_field_index
            rows, unit = unit_rows(batch.column(at("vec")), dims)
            ids = batch.column(at("id")).to_numpy()[rows]
            if known is not None:
                others, reps = known.value
                keep, marked = ~np.isin(ids, others), np.isin(ids, reps)
            else:
                flag = batch.column(at("flag")).to_numpy()[rows]
                keep, marked = flag >= 0, flag > 0
            return (ids * 2 + marked)[keep], unit[keep]

        return read

    def pivots(self) -> list[np.ndarray]:
        """For each partition the pivots of its cells, drawn from at most ``SAMPLE`` vectors spread over the table."""
        share = min(1.0, 1.2 * SAMPLE / max(1, self.rows))
        drawn = self.df.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id", F.lit(7))).limit(SAMPLE).toPandas()
        _, rows = unit_rows(pa.array(drawn.vec.tolist() if len(drawn) else [], pa.list_(pa.float32())), self.dims)
        count = int(np.clip(round(self.rows / CELL), 1, min(MAX_PIVOTS, max(1, len(rows)))))
        rng = np.random.default_rng(20)
        self.sample = rows
        return [rows[rng.choice(len(rows), count, replace=False)] if len(rows) else np.zeros((1, self.dims), np.float32) for _ in range(TREES)]


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + 8192] @ pivots.T).argmax(axis=1) for i in range(0, len(rows), 8192)]) if len(rows) else np.empty(0, np.int64)


def _best(edges: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of edges (u, v, s, f, h) the ``k`` most similar of each u, each once, best first, ties to the smaller. An entry that is
    there more than once is new only if all say so, and keeps the marks of all."""
    u, v, s, f, h = edges
    order = np.lexsort((v, u))
    u, v, s, f, h = u[order], v[order], s[order], f[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.empty(0, np.int64)
    if len(at):
        s, f = np.maximum.reduceat(s, at), np.bitwise_or.reduceat(f & ~np.uint8(NEW), at) | np.bitwise_and.reduceat(f, at) & np.uint8(NEW)
    u, v, h = u[at], v[at], h[at]
    order = np.lexsort((v, -s, u))
    keep = order[np.arange(len(u)) - np.searchsorted(u, u, "left") < k]
    return [x[keep] for x in (u, v, s, f, h)]


def _blobs(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows packed into one piece for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.array([0])
    arrays: list[pa.Array] = [pa.array(part[edges[:-1]].astype(np.int64))]
    for column in columns:
        column = np.ascontiguousarray(column[order])
        width = column.dtype.itemsize * (column.shape[1] if column.ndim > 1 else 1)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32).tobytes()), pa.py_buffer(column.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *names])


def _open(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


_EDGES = "part bigint, u binary, v binary, s binary, f binary, h binary"
_NAMES, _KINDS = ["u", "v", "s", "f", "h"], (np.int64, np.int64, np.float32, np.uint8, np.int32)


def _opened(piece: pa.Table) -> list[np.ndarray]:
    return [_open(piece.column(name), kind) for name, kind in zip(_NAMES, _KINDS, strict=True)]


def _homes(pivots: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """A home for each pivot: halves of like weight along the line between two far ones, again and again."""
    home, rows, step = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], parts
    while step > 1:
        step, halves = step // 2, []
        for own in rows:
            if len(own) > 1:
                x = pivots[own]
                far = x[(x @ x[0]).argmin()]
                own = own[np.argsort(x @ (far - x[(x @ far).argmin()]), kind="stable")]
                half = int(np.clip(np.searchsorted(np.cumsum(weight[own]), weight[own].sum() / 2, "right"), 1, len(own) - 1))
                home[own[half:]] += step
                halves += [own[:half], own[half:]]
            else:
                halves.append(own)
        rows = halves
    return home


class Cells:
    """The pivots of all partitions, in how many shards each of their cells is parted, and the homes of the first one's."""

    def __init__(self, nodes: Nodes, parts: int):
        self.pivots, self.shards, self.parts = nodes.pivots(), [], parts
        for p in self.pivots:
            held = np.bincount(_nearest(nodes.sample, p), minlength=len(p)) * (nodes.rows / max(1, len(nodes.sample)))
            self.shards.append(np.maximum(1, np.ceil(held / SHARD)).astype(np.int64))
            if len(self.shards) == 1:
                self.home = _homes(p, held + 1, parts)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        return self.home[_nearest(unit, self.pivots[0])]

    def place(self, codes: np.ndarray, unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The cell and shard of each vector in each partition, and its home."""
        whole = []
        for t, (p, b) in enumerate(zip(self.pivots, self.shards, strict=True)):
            cell = _nearest(unit, p)
            shard = ((codes.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % b[cell].astype(np.uint64)).astype(np.int64)
            whole.append((np.int64(t) << 56) + (cell << 24) + shard)
            if not t:
                home = self.home[cell]
        return whole, home

    def reach(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of vectors from outside, and the cells they look into: all shards of the nearest in each partition."""
        rows, whole = [], []
        for t, (p, b) in enumerate(zip(self.pivots, self.shards, strict=True)):
            cell = _nearest(unit, p)
            n = b[cell]
            row = np.repeat(np.arange(len(unit)), n)
            rows.append(row)
            whole.append((np.int64(t) << 56) + (cell[row] << 24) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(rows), np.concatenate(whole)


def _leaves(unit: np.ndarray, leaf: int, seed: int) -> Iterator[np.ndarray]:
    """The rows of a cell in leaves of at most ``leaf``, divided by pivots of their own."""
    rng, left = np.random.default_rng(seed), [np.arange(len(unit))]
    while left:
        own = left.pop()
        if len(own) <= leaf:
            yield own
            continue
        count = min(64, -(-2 * len(own) // leaf))
        at = _nearest(unit[own], unit[own[rng.choice(len(own), count, replace=False)]])
        parts = [own[at == i] for i in np.unique(at)]
        left += parts if len(parts) > 1 else [own[: len(own) // 2], own[len(own) // 2 :]]


def _within(codes: np.ndarray, unit: np.ndarray, home: np.ndarray, mark: int, leaf: int, seed: int, most: int) -> list[np.ndarray]:
    """The homes of the first ends, and edges to the best of each leaf."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for own in _leaves(unit, leaf, seed):
        k = min(most, len(own) - 1)
        if k < 1:
            continue
        sims = unit[own] @ unit[own].T
        np.fill_diagonal(sims, -2)
        best = np.argpartition(sims, len(own) - k, axis=1)[:, -k:]
        other = own[best].ravel()
        for column, x in zip(out, (np.repeat(home[own], k), np.repeat(codes[own], k), codes[other], np.take_along_axis(sims, best, 1).ravel(), home[other]), strict=True):
            column.append(x)
    if not out[0]:
        return []
    part, u, v, s, h = (np.concatenate(x) for x in out)
    return [part, u, v, s.astype(np.float32), np.full(len(u), NEW | mark, np.uint8), h]


def _gathered(df: DataFrame) -> DataFrame:
    """Pieces of one part together and in order."""
    return df.repartition(default_parallelism(df.sparkSession), "part").sortWithinPartitions("part")


def _by_part(pieces: DataFrame, work, schema: str) -> DataFrame:
    """``work(part, table of its pieces)`` gives batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            key = rows.column(0).to_numpy()
            for a, b in _runs(key):
                yield from work(int(key[a]), rows.slice(a, b - a))

    return _gathered(pieces).mapInArrow(walk, schema)


def first_graph(nodes: Nodes, sent, leaf: int = LEAF, kept: int = KEPT) -> DataFrame:
    """Edges to the best of each leaf, packed by the home of the first end."""
    read, dims = nodes.mapper(), nodes.dims

    def place(batch: pa.RecordBatch) -> pa.Table:
        codes, unit = read(batch)
        whole, home = sent.value.place(codes, unit)
        half = unit.astype(np.float16)
        return pa.Table.from_batches([_blobs(part, [codes, half, home], ["codes", "unit", "home"]) for part in whole])

    def work(cell: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, home = _open(piece.column(1), np.int64), _open(piece.column(3), np.int32)
        unit = _open(piece.column(2), np.float16).reshape(-1, dims).astype(np.float32)
        order = np.argsort(codes, kind="stable")
        codes, unit, home = codes[order], unit[order], home[order]
        once = np.concatenate([[True], codes[1:] != codes[:-1]])  # a row may be delivered twice
        edges = _within(codes[once], unit[once], home[once], 1 << (cell >> 56), leaf, cell, max(1, kept - 2))
        if edges:
            yield _blobs(edges[0].astype(np.int64), edges[1:], _NAMES)

    placed = map_batches(nodes.source, place, "part bigint, codes binary, unit binary, home binary")
    return _by_part(placed, work, _EDGES)


def random_graph(nodes: Nodes, sent, kept: int = KEPT, seed: int = 5) -> DataFrame:
    """Edges to vectors drawn at random: the graph to start from where nothing is known. Each vector is dealt to two buckets of
    a few thousand and draws half of its edges in either, so the buckets hang together."""
    read, buckets = nodes.mapper(), max(1, round(nodes.rows / 4096))

    def place(batch: pa.RecordBatch) -> pa.Table:
        codes, unit = read(batch)
        home, dealt = sent.value.homes(unit), []
        for i, factor in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))):
            bucket = (codes.view(np.uint64) * factor >> np.uint64(33)) % np.uint64(buckets)
            dealt.append(_blobs(2 * bucket.astype(np.int64) + i, [codes, home], ["codes", "home"]))
        return pa.Table.from_batches(dealt)

    def work(bucket: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, first = np.unique(_open(piece.column(1), np.int64), return_index=True)
        home = _open(piece.column(2), np.int32)[first]
        k = min(-(-kept // 2), len(codes) - 1)
        if k > 0:
            other = (np.arange(len(codes))[:, None] + np.random.default_rng(seed + bucket).integers(1, len(codes), (len(codes), k))) % len(codes)
            u, h, v, g = np.repeat(codes, k), np.repeat(home, k), codes[other].ravel(), home[other].ravel()
            yield _blobs(h.astype(np.int64), [u, v, np.full(len(u), -2, np.float32), np.full(len(u), NEW, np.uint8), g], _NAMES)

    return _by_part(map_batches(nodes.source, place, "part bigint, codes binary, home binary"), work, _EDGES)


def merged(edges: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best ``kept`` edges of each node from all pieces, packed again, and how many of them are new."""

    def work(part: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _best(_opened(piece), kept)
        out = _blobs(np.full(len(found[0]), part), found, _NAMES)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([int((found[3] >= NEW).sum())])], names=[*out.schema.names, "fresh"])

    return _by_part(edges, work, _EDGES + ", fresh bigint")


def _both_ways(lists: DataFrame) -> DataFrame:
    """Every list at its home, and every entry of it at the home of the other end."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for r in range(batch.num_rows):
            u, v, s, f, h = (np.frombuffer(batch.column(name)[r].as_py(), kind) for name, kind in zip(_NAMES, _KINDS, strict=True))
            part = batch.column("part")[r].as_py()
            own = pa.RecordBatch.from_arrays([batch.column(c).slice(r, 1) for c in ("part", *_NAMES)] + [pa.array([True])], names=["part", *_NAMES, "own"])
            back = _blobs(h.astype(np.int64), [v, u, np.zeros(len(u), np.float32), f, np.full(len(u), part, np.int32)], _NAMES)
            out += [own, pa.RecordBatch.from_arrays([*back.columns, pa.array(np.zeros(back.num_rows, bool))], names=own.schema.names)]
        return pa.Table.from_batches(out)

    return map_batches(lists, run, _EDGES + ", own boolean")


_ASKS = "part bigint, code binary, unit binary, least binary, m binary, u binary, f binary, p binary"


def _ask_rows(blobs: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of all columns of ``_ASKS``, null where ``blobs`` has none."""
    names = [c.split(" ")[0] for c in _ASKS.split(", ")]
    nothing = pa.nulls(blobs.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([blobs.column(c) if c in blobs.schema.names else nothing for c in names], names=names)


def _meetings(lists: DataFrame, met: int) -> DataFrame:
    """For every node at which some that have not met may meet, who comes: the member, the node, the marks of the entry and the
    node's home, packed by the home of the member. With it the least similarity in the list of each node."""

    def work(part: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        own = piece.column("own").to_numpy()
        u, v, s, f, h = _opened(piece.filter(pa.array(own)))
        last = np.flatnonzero(np.concatenate([u[1:] != u[:-1], [True]])) if len(u) else np.empty(0, np.int64)
        yield _ask_rows(_blobs(np.full(len(last), part), [u[last], s[last]], ["code", "least"]))
        w, x, _, g, p = _opened(piece.filter(pa.array(~own)))
        # of those that have the node as a neighbour the first few, new ones in front, others in an order of their own
        order = np.lexsort(((x ^ w * np.int64(0x9E3779B1)) * np.int64(0x85EBCA6B), g < NEW, w))
        w, x, g, p = w[order], x[order], g[order], p[order]
        go = np.arange(len(w)) - np.searchsorted(w, w, "left") < met
        node, member, mark, home = np.concatenate([u, w[go]]), np.concatenate([v, x[go]]), np.concatenate([f, g[go]]), np.concatenate([h, p[go]])
        order = np.lexsort((member, node))
        node, member, mark, home = node[order], member[order], mark[order], home[order]
        if not len(node):
            return
        at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (member[1:] != member[:-1])]))
        node, member, home, mark = node[at], member[at], home[at], np.bitwise_or.reduceat(mark, at)
        # nothing to compare where no member is new, or where all stood in one leaf
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.concatenate([at, [len(node)]]))
        open_ = (np.bitwise_or.reduceat(mark, at) >= NEW) & (np.bitwise_and.reduceat(mark & ~np.uint8(NEW), at) == 0) & (size > 1)
        go = np.repeat(open_, size)
        yield _ask_rows(_blobs(home[go].astype(np.int64), [member[go], node[go], mark[go], np.full(go.sum(), part, np.int32)], ["m", "u", "f", "p"]))

    return _by_part(_both_ways(lists), work, _ASKS)


_ANSWERS = "part bigint, home int, m binary, unit binary, least binary, size binary, u binary, f binary"


def _answered(nodes: Nodes, sent, asks: DataFrame) -> DataFrame:
    """Members with their vectors, once to each home of nodes they come to."""
    read, dims = nodes.mapper(), nodes.dims

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, unit = read(batch)
        return _ask_rows(_blobs(sent.value.homes(unit).astype(np.int64), [codes, unit.astype(np.float16)], ["code", "unit"]))

    def work(part: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        least_rows = ~np.asarray(piece.column("least").is_null())
        vectors_, known = piece.filter(pa.array(~np.asarray(piece.column("unit").is_null()))), piece.filter(pa.array(least_rows))
        codes, first = np.unique(_open(vectors_.column("code"), np.int64), return_index=True)
        unit = _open(vectors_.column("unit"), np.float16).reshape(-1, dims)[first]
        least, at = np.full(len(codes), -2, np.float32), _open(known.column("code"), np.int64)
        if len(codes):
            place = np.minimum(np.searchsorted(codes, at), len(codes) - 1)
            there = codes[place] == at
            least[place[there]] = _open(known.column("least"), np.float32)[there]
        m, u, f, p = (_open(piece.column(c), kind) for c, kind in (("m", np.int64), ("u", np.int64), ("f", np.uint8), ("p", np.int32)))
        if not len(m) or not len(codes):
            return
        place = np.minimum(np.searchsorted(codes, m), len(codes) - 1)
        there = codes[place] == m
        m, u, f, p, place = m[there], u[there], f[there], p[there], place[there]
        order = np.lexsort((u, m, p))
        m, u, f, p, place = m[order], u[order], f[order], p[order], place[order]
        if not len(m):
            return
        for a, b in _runs(p):
            own, at, size = np.unique(m[a:b], return_index=True, return_counts=True)
            row = place[a:b][at]
            columns = [own, unit[row], least[row], size.astype(np.uint32), u[a:b], f[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array([int(p[a])]), pa.array([part], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns)], names=[c.split(" ")[0] for c in _ANSWERS.split(", ")])

    return _by_part(asks.unionByName(map_batches(nodes.source, vectors, _ASKS)), work, _ANSWERS)


def _joined(answers: DataFrame, dims: int) -> DataFrame:
    """The local joins: at every node its members against each other; what is better than the last of a list goes to its home."""

    def work(part: int, piece: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.float16, np.float32, np.uint32, np.int64, np.uint8)
        m, unit, least, size, u, f = (_open(piece.column(i + 2), kind) for i, kind in enumerate(kinds))
        home = np.repeat(piece.column("home").to_numpy(), [len(x) // 8 for x in piece.column("m").to_pylist()])
        unit, who = unit.reshape(-1, dims), np.repeat(np.arange(len(m)), size)
        order = np.lexsort((who, u))
        u, f, who = u[order], f[order], who[order]
        at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        count = np.diff(np.concatenate([at, [len(u)]]))
        a_all, b_all, s_all = [], [], []
        for width in np.unique(count[count > 1]).tolist():
            i, j = np.triu_indices(width, 1)
            rows = at[count == width]
            for start in range(0, len(rows), 2048):
                own = rows[start : start + 2048, None] + np.arange(width)
                mark, member = f[own], who[own]
                x = unit[member].astype(np.float32)
                sims = np.matmul(x, x.transpose(0, 2, 1))[:, i, j]
                both, either = mark[:, i] & mark[:, j], mark[:, i] | mark[:, j]
                a, b = member[:, i], member[:, j]
                go = (either >= NEW) & (both & np.uint8(NEW - 1) == 0) & ((sims > least[a]) | (sims > least[b]))
                a_all.append(a[go])
                b_all.append(b[go])
                s_all.append(sims[go])
        if not a_all:
            return
        a, b, s = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(s_all).astype(np.float32)
        _, first = np.unique(np.minimum(a, b) * len(m) + np.maximum(a, b), return_index=True)
        a, b, s = a[first], b[first], s[first]
        a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        go = s > least[a]
        a, b, s = a[go], b[go], s[go]
        if len(a):
            yield _blobs(home[a].astype(np.int64), [m[a], m[b], s, np.full(len(a), NEW, np.uint8), home[b].astype(np.int32)], _NAMES)

    return _by_part(answers, work, _EDGES)


def _old(lists: DataFrame) -> DataFrame:
    """The lists with no entry new."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = pa.array([(np.frombuffer(x, np.uint8) & np.uint8(NEW - 1)).tobytes() for x in batch.column("f").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([marks if c == "f" else batch.column(c) for c in ("part", *_NAMES)], names=["part", *_NAMES])

    return map_batches(lists, run, _EDGES)


def sent_cells(nodes: Nodes):
    """The cells for all tasks: at most MAX_PIVOTS pivots for each partition."""
    parts = 1 << int(np.ceil(np.log2(4 * default_parallelism(nodes.df.sparkSession))))
    return nodes.df.sparkSession.sparkContext.broadcast(Cells(nodes, parts))


def descend(nodes: Nodes, sent, first: DataFrame, rounds: int = ROUNDS, kept: int = KEPT) -> DataFrame:
    """The packed lists after NN-descent from a first graph, until few change."""
    def counted(lists: DataFrame) -> int:
        """The new entries; after that job nothing holds what led to the lists any longer."""
        fresh = lists.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
        release(nodes.df.sparkSession)
        return fresh

    lists = cut(merged(first, kept))
    enough = UPDATES * kept * max(1, nodes.rows - nodes.copied)
    fresh = counted(lists)
    for _ in range(rounds):
        if not fresh:
            break
        better = _joined(_answered(nodes, sent, _meetings(lists, max(MET, kept))), nodes.dims)
        lists = cut(merged(_old(lists).unionByName(better), kept))
        del better
        fresh = counted(lists)
        if fresh <= enough:
            break
    return lists


def graph(nodes: Nodes, sent, rounds: int = ROUNDS, leaf: int = LEAF, kept: int = KEPT) -> DataFrame:
    """The packed neighbour lists."""
    return descend(nodes, sent, first_graph(nodes, sent, leaf, kept), rounds, kept)


def neighbours(df: DataFrame, k: int = 5, dims: int = 64, rounds: int = ROUNDS, leaf: int = LEAF, kept: int = KEPT, from_random: bool = False) -> DataFrame:
    """(id, other, similarity): for each usable vector of ``df`` (id, vec) its ``k`` most similar others."""
    if k > kept:
        raise ValueError(f"k is at most {kept}")
    nodes = Nodes(df, dims)
    sent = sent_cells(nodes)
    lists = descend(nodes, sent, random_graph(nodes, sent, kept), rounds, kept) if from_random else graph(nodes, sent, rounds, leaf, kept)

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for r in range(batch.num_rows):
            u, v, s = (np.frombuffer(batch.column(i)[r].as_py(), kind) for i, kind in ((1, np.int64), (2, np.int64), (3, np.float32)))
            place = np.arange(len(u)) - np.searchsorted(u, u, "left")
            marked = np.zeros(len(u), bool)
            for code in (u, v):  # a node with copies in it or in its list needs them put in
                marked |= np.isin(u, u[code & 1 == 1])
            keep = (place < k) | marked
            parts.append((u[keep] >> 1, v[keep] >> 1, s[keep], marked[keep]))
        if not parts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)], names=["u", "v", "similarity", "marked"])

    flat = map_batches(lists, edges, "u bigint, v bigint, similarity float, marked boolean")
    if not nodes.copied:
        return flat.select(F.col("u").alias("id"), F.col("v").alias("other"), "similarity")
    flat = cut(flat)
    plain = flat.where("NOT marked").select(F.col("u").alias("id"), F.col("v").alias("other"), "similarity")
    # the least k + 1 ids of each class of copies are all that any list can need
    least = nodes.copies.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1).select("rep", F.col("id").alias("copy"))
    sizes = nodes.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    outer = flat.where("marked").join(least.withColumnRenamed("rep", "v"), "v", "left").select("u", F.coalesce("copy", "v").alias("other"), "similarity")
    best = outer.withColumn("place", F.row_number().over(W.partitionBy("u").orderBy(F.desc("similarity"), "other"))).where(F.col("place") <= k).drop("place")
    inner = least.select(F.col("rep").alias("u"), F.col("copy").alias("other"), F.lit(2.0).cast("float").alias("similarity"))
    offers = best.unionByName(inner).groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), 1, 2 * k + 1).alias("offers"))
    offers = offers.join(sizes.withColumnRenamed("rep", "u"), "u", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    members = look_up(nodes.copies.withColumnRenamed("rep", "u"), "u", offers, "n", nodes.copied).select("id", "offers")
    alone = offers.where("n = 1").select(F.col("u").alias("id"), "offers")
    chosen = members.unionByName(alone).select("id", F.explode(F.slice(F.filter("offers", lambda o: o["other"] != F.col("id")), 1, k)).alias("o"))
    return plain.unionByName(chosen.select("id", F.col("o.other").alias("other"), F.least(F.lit(1.0).cast("float"), (-F.col("o.s"))).alias("similarity")))


def entered(nodes: Nodes, sent, queries: DataFrame, entries: int) -> DataFrame:
    """(query, node): the ``entries`` most similar nodes of each query (query, vec) in each cell and shard it reaches."""
    read, dims = nodes.mapper(), nodes.dims

    def place(batch: pa.RecordBatch) -> pa.Table:
        codes, unit = read(batch)
        half = unit.astype(np.float16)
        return pa.Table.from_batches([_blobs(part, [codes >> 1, half], ["node", "unit"]) for part in sent.value.place(codes, unit)[0]])

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, unit = unit_rows(batch.column(1), dims)
        rows, part = sent.value.reach(unit)
        return _blobs(part, [batch.column(0).to_numpy()[at][rows], unit.astype(np.float16)[rows]], ["node", "unit"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            key, asks = rows.column(0).to_numpy(), rows.column(3).to_numpy()
            for a, b in _runs(key):
                piece = rows.slice(a, b - a)
                (query, q), (node, unit) = ((_open(x.column(1), np.int64), _open(x.column(2), np.float16).reshape(-1, dims).astype(np.float32)) for x in (piece.filter(pa.array(asks[a:b])), piece.filter(pa.array(~asks[a:b]))))
                n = min(entries, len(node))
                if not n:
                    continue
                for i in range(0, len(query), 1024):
                    best = np.argpartition(q[i : i + 1024] @ unit.T, len(node) - n, axis=1)[:, -n:]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query[i : i + 1024], n)), pa.array(node[best].ravel())], names=["query", "node"])

    n, packed = default_parallelism(nodes.df.sparkSession), "part bigint, node binary, unit binary"
    both = map_batches(nodes.source, place, packed).withColumn("asks", F.lit(False)).unionByName(map_batches(queries, ask, packed).withColumn("asks", F.lit(True)))
    return both.repartition(n, "part").sortWithinPartitions("part").mapInArrow(walk, "query bigint, node bigint").distinct()


def search(df: DataFrame, queries: DataFrame, k: int = 5, dims: int = 64, width: int = 24, entries: int = 6, most_steps: int = 12) -> DataFrame:
    """(query, other, similarity): the ``k`` most similar vectors of ``df`` (id, vec) for each query (query, vec).

    Every query starts at the ``entries`` most similar vectors of each cell it falls into, so that no part of the table is
    without a way in, and goes on to the neighbours of the best ``width`` it has met, until these bring nothing new. A step
    is a join with the lists and one with the vectors. Of a group of copies the one with the least id is found.
    """
    if width < k or entries > width:
        raise ValueError("width must be at least k and entries")
    nodes = Nodes(df, dims)
    if not nodes.rows:
        return df.sparkSession.createDataFrame([], "query bigint, other bigint, similarity float")
    read, sent = nodes.mapper(), sent_cells(nodes)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, unit = read(batch)
        return pa.RecordBatch.from_arrays([pa.array(codes >> 1), pa.array(list(unit), pa.list_(pa.float32()))], names=["node", "v"])

    vectors = cut(map_batches(nodes.source, rows, "node bigint, v array<float>"))

    def lists_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        u, v = (np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(i).to_pylist()] or [np.empty(0, np.int64)]) for i in (1, 2))
        both = np.concatenate([np.stack([u, v], axis=1), np.stack([v, u], axis=1)]) >> 1
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["node", "next"])

    edges = cut(map_batches(graph(nodes, sent), lists_of, "node bigint, next bigint").distinct())
    def usable(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, unit = unit_rows(batch.column(1), dims)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(unit), pa.list_(pa.float32()))], names=["query", "q"])

    wanted = queries.select("query", "vec").where("query IS NOT NULL AND vec IS NOT NULL").dropDuplicates(["query"])
    asked = cut(map_batches(wanted, usable, "query bigint, q array<float>"))
    by_query = W.partitionBy("query").orderBy(F.desc("similarity"), "node")

    def compared_to(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, v = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)).astype(np.float32) for i in (2, 3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", q, v)), pa.array(np.ones(len(q), bool))], names=["query", "node", "similarity", "fresh"])

    def scored(pairs: DataFrame) -> DataFrame:
        return map_batches(pairs.join(vectors, "node").join(asked, "query").select("query", "node", "q", "v"), compared_to, "query bigint, node bigint, similarity float, fresh boolean")

    met = cut(scored(entered(nodes, sent, wanted, entries)))
    for _ in range(most_steps):
        best = met.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= width)
        grown = best.where("fresh").join(edges, "node").select("query", F.col("next").alias("node")).distinct()
        new = grown.join(met.select("query", "node"), ["query", "node"], "left_anti")
        # of what was met only the best of each query can matter again; they are kept to know them as visited
        met = cut(met.withColumn("fresh", F.lit(False)).unionByName(scored(new)))
        if not met.withColumn("place", F.row_number().over(by_query)).where((F.col("place") <= width) & F.col("fresh")).limit(1).count():
            break
    found = met.where("node <> query").withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k)
    return found.select("query", F.col("node").alias("other"), "similarity")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "static_vector").select(F.col("vec_id").alias("id"), F.col("vec_values").alias("vec"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar to the other."""
    return neighbours(_vectors(spark, sf_dir)).select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each, with their similarity."""
    return neighbours(_vectors(spark, sf_dir))


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search for every vector whose id is divisible by 20, against all."""
    v = _vectors(spark, sf_dir)
    return search(v, v.where("id % 20 = 0").select(F.col("id").alias("query"), "vec"))
