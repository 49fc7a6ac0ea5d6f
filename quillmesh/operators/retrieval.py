"""A store of documents with posting lists, candidates, ranking, and upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import normalize, tokens
from quillmesh.functions import tables as T
from quillmesh.runtime import cut, map_batches, sampled
from quillmesh.sources.packs import Lexicon


#: Channels whose keys come from expressions, and those that read the text in Python.
CHANNELS = ("lexical", "normalized", "character")
READ_CHANNELS = ("symbol", "minhash", "semantic", "phonetic", "transliteration", "decoded", "concept")


def postings(docs: DataFrame, channels: tuple[str, ...] = CHANNELS, lexicon: Lexicon | None = None) -> DataFrame:
    """(channel, key, id) of documents (id, text).

    Words and lemmas, the normalized text, and trigrams of its head; on demand also signs, places of a MinHash signature,
    tenths of the first dimensions of a hashed vector, sounds, words of the transcription, words of the readings, and the
    concepts and readings of signs. Null and empty texts have no keys.
    """
    unknown = set(channels) - {*CHANNELS, *READ_CHANNELS}
    if unknown:
        raise ValueError(f"no such channels: {sorted(unknown)}")
    norm = normalize.normalized(F.col("text"))
    base = docs.where(F.length("text") > 0).select("id", "text", norm.alias("n"))
    made = {
        "lexical": lambda: base.select(F.lit("lexical").alias("channel"), F.explode(F.array_distinct(F.concat(tokens.words(F.col("text")), F.transform(tokens.words(F.col("text")), tokens.lemma)))).alias("key"), "id"),
        "normalized": lambda: base.select(F.lit("normalized").alias("channel"), F.xxhash64("n").cast("string").alias("key"), "id"),
        "character": lambda: base.select(F.lit("character").alias("channel"), F.explode(F.array_distinct(tokens.char_ngrams(F.left("n", F.lit(256)), 3))).alias("key"), "id"),
    }
    parts = [made[c]() for c in CHANNELS if c in channels]
    read = tuple(c for c in READ_CHANNELS if c in channels)
    if read:
        parts.append(_read_postings(docs.where(F.length("text") > 0).select("id", "text"), read, lexicon))
    return reduce(DataFrame.unionByName, parts)


def _read_postings(docs: DataFrame, channels: tuple[str, ...], lexicon: Lexicon | None) -> DataFrame:
    """The postings that need a text read: one Arrow pass for all of them."""
    import numpy as np

    from quillmesh.functions.normalize import fold_text
    from quillmesh.functions.rebus import decode_text
    from quillmesh.functions.sounds import latin_view, sounds_of
    from quillmesh.sources import packs

    lexicon = lexicon or packs.load()

    def keys(text: str) -> Iterator[tuple[str, str]]:
        signs = [p for p, _, _, kind in tokens.segment_text(text) if kind in ("emoji", "symbol")] if {"symbol", "concept"} & set(channels) else []
        for channel in channels:
            if channel == "symbol":
                found = signs
            elif channel == "minhash":
                found = [f"{i}:{v}" for i, v in enumerate(tokens.minhash_tokens(tokens.words_text(text), saturating=False))]
            elif channel == "semantic":
                found = [f"{i}:{v}" for i, v in enumerate(np.round(tokens.feature_hash_texts([text])[0][:8] * 10).astype(int).tolist())]
            elif channel == "phonetic":
                found = ["".join(sounds_of(w)) for w in tokens.words_text(text)]
            elif channel == "transliteration":
                found = tokens.words_text(latin_view(text) or "")
            elif channel == "decoded":
                found = [w for r in decode_text(text, lexicon) if r["changed"] for w in fold_text(r["text"]).split()]
            else:
                found = [x for s in signs for x in (*lexicon.concepts.get(s, []), *(fold_text(t) for t, _, _ in lexicon.symbols.get(s.replace("️", ""), [])))]
            yield from ((channel, k) for k in dict.fromkeys(found) if k)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, take = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = list(keys(text))
            rows += own
            take += [i] * len(own)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), batch.column(0).take(pa.array(take, pa.int64()))], names=["channel", "key", "id"])

    return map_batches(docs, run, f"channel string, key string, id {dict(docs.dtypes)['id']}")


def first_of_lists(index: DataFrame, wanted: DataFrame, per_list: int = T.PER_LIST) -> DataFrame:
    """The rows of ``index`` (channel, key, id) whose keys ``wanted`` has, the ``per_list`` least ids of each list.

    Keys that nobody asks for go where the index is read; the window then keeps ``per_list`` rows of a list in every task
    before anything is shuffled, so a word of all documents is never sorted in one place.
    """
    asked = index.join(wanted.select("channel", "key").distinct(), ["channel", "key"], "left_semi")
    return asked.withColumn("_k", F.row_number().over(W.partitionBy("channel", "key").orderBy("id"))).where(F.col("_k") <= per_list).drop("_k")


def candidates(index: DataFrame, queries: DataFrame, per_list: int = T.PER_LIST, channels: tuple[str, ...] = CHANNELS, lexicon: Lexicon | None = None) -> DataFrame:
    """(query, id, channels, shared) of the documents that share a key with a query, at most ``per_list`` from each list, by id.

    The cap is the retrieval feature it stands for in the API.
    """
    return met_of(index, postings(queries, channels, lexicon).withColumnRenamed("id", "query"), per_list)


def met_of(index: DataFrame, wanted: DataFrame, per_list: int = T.PER_LIST) -> DataFrame:
    """The same for keys that are made already: ``wanted`` holds channel, key and query."""
    met = wanted.join(first_of_lists(index, wanted, per_list), ["channel", "key"])
    return met.groupBy("query", "id").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.count(F.lit(1)).alias("shared"))


def preranked(found: DataFrame, queries: DataFrame, docs: DataFrame, most: int = T.CANDIDATES) -> DataFrame:
    """Candidates by shared words, signature and equality, ties by id, the first ``most`` of each query."""

    def side(df: DataFrame, key: str) -> DataFrame:
        text = F.col("text")
        return df.select(F.col("id").alias(key), F.array_distinct(tokens.words(text)).alias(f"w_{key}"), normalize.normalized(text).alias(f"n_{key}"), tokens.minhash(tokens.words(text)).alias(f"m_{key}"))

    both = found.join(side(queries, "query"), "query").join(side(docs, "id"), "id")
    shared = F.size(F.array_intersect("w_query", "w_id")) / F.greatest(F.size("w_query"), F.lit(1))
    alike = tokens.signature_similarity(F.col("m_query"), F.col("m_id"))
    scored = both.select("query", "id", "channels", (0.55 * shared + 0.35 * alike + F.when(F.col("n_query") == F.col("n_id"), 0.10).otherwise(0.0)).alias("prerank"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("prerank"), "id"))).where(F.col("rank") <= most)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for other lengths or a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)


def buckets(v: Column) -> Column:
    """The first eight dimensions in tenths."""
    return F.transform(F.slice(v, 1, 8), lambda x: F.round(x.cast("double") * 10).cast("int"))


#: Queries that are broadcast at once.
QUERY_BLOCK = 50_000


def exact_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar vectors of each query (id, vector), by cosine (rounded to 12 digits), ties by id; one of another length or of
    length zero has the cosine 0, nulls take no part.

    Queries are a stated set. They go out in blocks of at most ``QUERY_BLOCK``, whatever their number; each task lays its
    vectors against a block as one matrix product and sends the best ``k`` of each query once.
    """
    import numpy as np

    vectors, queries = vectors.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL"), queries.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    blocks = -(-queries.count() // QUERY_BLOCK)
    kind = dict(vectors.dtypes)["id"]
    parts = []
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(blocks)) == block)
        rows = own.toPandas()  # about QUERY_BLOCK
        if rows.empty:
            continue
        ids, asked = rows["id"].to_numpy(), [np.asarray(v, np.float64) for v in rows["vector"]]
        parts.append(top_rows(vectors, ids, asked, k, kind))
    if not parts:
        return vectors.limit(0).select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def top_rows(vectors: DataFrame, ids, asked: list, k: int, kind: str) -> DataFrame:
    """(query, id, similarity): of each task's vectors the best ``k`` for each query."""
    import numpy as np

    dims = max(map(len, asked))
    right = np.array([len(v) == dims and np.linalg.norm(v) > 0 for v in asked])
    matrix = np.stack([v / np.linalg.norm(v) if ok else np.zeros(dims) for v, ok in zip(asked, right, strict=True)])
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best_s, best_i = np.full((len(ids), 0), -2.0), np.empty((len(ids), 0), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_pylist()
            rows = np.zeros((len(own), dims))
            for i, v in enumerate(batch.column(1).to_pylist()):
                if len(v) == dims and None not in v:
                    rows[i] = v
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows /= np.where(norm > 0, norm, 1)
            order = sorted(range(len(own)), key=own.__getitem__)
            own, rows = np.array(own, dtype=object)[order], rows[order]
            for start in range(0, len(own), 2048):
                s = np.round(matrix @ rows[start : start + 2048].T, 12)
                s[ids[:, None] == own[None, start : start + 2048]] = -3.0  # a query is no hit of its own
                s = np.concatenate([best_s, s], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(own[start : start + 2048], (len(ids), len(own[start : start + 2048])))], axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k] if s.shape[1] > k else np.argsort(-s, axis=1, kind="stable")
                best_s, best_i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        keep = best_s > -2.5
        row = np.nonzero(keep)[0]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row].tolist()), pa.array(best_i[keep].tolist()), pa.array(best_s[keep])], schema=pa.schema([("query", schema.field("id").type), ("id", schema.field("id").type), ("similarity", pa.float64())]))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(vectors.select("id").schema)
    return vectors.mapInArrow(run, f"query {kind}, id {kind}, similarity double")


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with ``rows`` in place of those of the same id."""
    return store.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def remove(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def migrated(rows: DataFrame, version: str = "schema_version", newest: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): rows of an older version stamped anew, and rows of a newer one."""
    v = F.coalesce(F.col(version), F.lit(1))
    return rows.where(v <= newest).withColumn(version, F.lit(newest)), rows.where(v > newest)


def cell_search(vectors: DataFrame, queries: DataFrame, k: int, probes: int = 4, cell: int = 1_000, sample: int = 20_000) -> DataFrame:
    """The rows of :func:`exact_search` by cells around pivots of a bounded sample; every vector is in a cell.

    A query looks into its ``probes`` nearest cells, then into all others that can hold a vector at least as near as its k-th
    hit: no member is nearer than the query's angle to the pivot less the widest angle in the cell. What is left out follows
    the data; where cells are wide, as among vectors without clusters, nothing is."""
    import numpy as np
    import pandas as pd

    from quillmesh.functions.lazy import arrow

    drawn = sampled(vectors.select("id", "vector"), "id", sample).toPandas()
    if drawn.empty:
        return vectors.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    rows = unit(drawn.vector)
    count = max(1, min(len(rows), round(vectors.count() / cell)))
    pivots = rows[np.random.default_rng(3).choice(len(rows), count, replace=False)]

    def angles(v: pd.Series):
        """The angles of each vector to all pivots, a few rows at a time."""
        x = unit(v)
        for i in range(0, len(x), 512):
            yield from np.arccos(np.clip(x[i : i + 512] @ pivots.T, -1, 1))

    def place(v: pd.Series) -> pd.DataFrame:
        best = [(int(a.argmin()), float(a.min())) for a in angles(v)]
        return pd.DataFrame(best, columns=["cell", "angle"])

    def near(v: pd.Series) -> pd.Series:
        return pd.Series([np.argsort(a, kind="stable")[:probes].astype(np.int32) for a in angles(v)])

    place.__annotations__ = {"v": pd.Series, "return": pd.DataFrame}
    near.__annotations__ = {"v": pd.Series, "return": pd.Series}
    by_query = W.partitionBy("query").orderBy(F.desc("similarity"), "id")
    placed = vectors.select("id", "vector", arrow("cell int, angle double")(place)(F.col("vector")).alias("at")).select("id", "vector", "at.cell", "at.angle")
    widest = placed.groupBy("cell").agg(F.max("angle").alias("angle")).toPandas()  # at most one row a pivot
    width = np.full(count, -np.inf)  # nobody is in the other cells
    width[widest.cell.to_numpy()] = widest.angle.to_numpy()

    def others(v: pd.Series, kth: pd.Series) -> pd.Series:
        found = []
        for a, s in zip(angles(v), kth, strict=True):
            reached = a - width <= np.arccos(np.clip(s, -1, 1)) + 1e-6
            reached[np.argsort(a, kind="stable")[:probes]] = False
            found.append(np.flatnonzero(reached).astype(np.int32))
        return pd.Series(found)

    others.__annotations__ = {"v": pd.Series, "kth": pd.Series, "return": pd.Series}

    def looked(asked: DataFrame) -> DataFrame:
        scored = asked.join(placed, "cell").where(F.col("query") != F.col("id")).select("query", "id", F.round(cosine(F.col("q"), F.col("vector")), 12).alias("similarity"))
        return scored.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    asked = queries.select(F.col("id").alias("query"), F.col("vector").alias("q"))
    first = cut(looked(asked.withColumn("cell", F.explode(arrow("array<int>")(near)(F.col("q"))))))
    kth = first.where(F.col("rank") == k).select("query", F.col("similarity").alias("kth"))  # none where fewer were met: all cells then
    reach = arrow("array<int>")(others)(F.col("q"), F.coalesce("kth", F.lit(-1.0)))
    second = looked(asked.join(kth, "query", "left").withColumn("cell", F.explode(reach)))
    return first.unionByName(second).drop("rank").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
