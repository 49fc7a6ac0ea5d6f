"""Problem 2: records of evaluation splits that occur, exactly or nearly, in training.

An exact prefix-filter join between two sides. Words are ordered by rarity over all records, the same order everywhere;
two sets of Jaccard similarity ``least`` share a word among the first ``n - ceil(least * n) + 1`` of each. The prefixes of
the evaluation side are the index; prefixes of the training side probe it, and a meeting only counts when the sizes and
the places of the shared word leave room for the overlap asked for. What passes is verified on whole sets.

Copies share one class on each side, joined once; their members are put in at the end, or only counted for the report.
Words that many records hold are salted: the evaluation side is repeated for each salt, the training side draws one.

Defined results: a record with a null text, or without any word, is no case; repeated deliveries count once; equal sets
are a case. An empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.components import look_up, salted
from quillmesh.llm.p6_splits import split_of
from quillmesh.llm.wordsets import binary_rows, by_rarity, count_of_level, prefix_length, rarity, same_sets, word_sets
from quillmesh.runtime import cut, map_batches, table

#: Records that a word may be in before its meetings are spread over salts.
HOT = 20_000


def _postings(classes: DataFrame, levels: np.ndarray, least: float, copied: bool) -> DataFrame:
    """(token, salt, set_hash, n, at) for each word of each prefix that another record may share."""
    sent = classes.sparkSession.sparkContext.broadcast(levels)  # of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column(0).to_numpy()
        toks, sizes = binary_rows(batch.column(2), np.uint64)
        row, toks, level = by_rarity(toks, sizes, sent.value)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        go = (at < prefix_length(sizes, least)[row]) & (level > 0)
        row, toks, level, at = row[go], toks[go], level[go], at[go]
        salts = 1 + (count_of_level(level) // HOT).astype(np.int64)
        if copied:
            salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
            row, toks, at = (np.repeat(x, salts) for x in (row, toks, at))
        else:
            salt = (hashes[row].view(np.uint64) % salts.astype(np.uint64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(toks.view(np.int64)), pa.array(salt), pa.array(hashes[row]), pa.array(sizes[row].astype(np.int32)), pa.array(at.astype(np.int32))], names=["token", "salt", "set_hash", "n", "at"])

    return map_batches(classes.select("set_hash", "n", "toks"), run, "token bigint, salt bigint, set_hash bigint, n int, at int")


def overlapping(records: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes and their members.

    ``records`` holds id, train (boolean), n_words, n, set_hash and toks. Returns the linked classes (train_hash,
    other_hash, shared, similarity), and (id, train, set_hash) of all records.
    """
    records = cut(records.where("n > 0"))
    levels = rarity(records)
    classes = cut(same_sets(records, "train"))
    index = _postings(classes.where(~F.col("train")), levels, least, True)
    probe = _postings(classes.where("train"), levels, least, False)
    a, b = index.alias("a"), probe.alias("b")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))  # true of the first word that both share
    met = (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")))
        .where((F.col("a.n") >= F.col("b.n") * least - 1e-9) & (F.col("b.n") >= F.col("a.n") * least - 1e-9) & (room >= need))
        .select(F.col("b.set_hash").alias("train_hash"), F.col("a.set_hash").alias("other_hash"))
        .distinct()
    )
    sets = classes.select("train", "set_hash", "n", "toks")
    pairs = (
        met.join(sets.where("train").select(F.col("set_hash").alias("train_hash"), F.col("toks").alias("x")), "train_hash")
        .join(sets.where(~F.col("train")).select(F.col("set_hash").alias("other_hash"), F.col("toks").alias("y")), "other_hash")
    )

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        (x, nx), (y, ny) = binary_rows(batch.column(2), np.uint64), binary_rows(batch.column(3), np.uint64)
        row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
        both = np.concatenate([x, y])
        order = np.lexsort((both, row))
        both, row = both[order], row[order]
        twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
        shared = np.bincount(row[1:][twice], minlength=len(nx))
        similar = shared / np.maximum(nx + ny - shared, 1)
        go = pa.array(similar >= least - 1e-9)
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.astype(np.int32)), pa.array(similar)], names=["train_hash", "other_hash", "shared", "similarity"])
        return kept.filter(go)

    linked = map_batches(pairs.select("train_hash", "other_hash", "x", "y"), verify, "train_hash bigint, other_hash bigint, shared int, similarity double")
    return linked, records.select("id", "train", "set_hash").distinct()


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = table(spark, sf_dir, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", (split_of("split") == "train").alias("train"), "a", "b")
    return overlapping(word_sets(cases, ["id", "train"], "a", "b"))


def pairs_of(linked: DataFrame, members: DataFrame) -> DataFrame:
    """(train_id, other_id, similarity) of all records of linked classes. The members of large classes are dealt out over
    tasks on either side, so no task writes all pairs of one."""
    members = cut(members)
    total = members.count()
    train = members.where("train").select(F.col("id").alias("train_id"), F.col("set_hash").alias("train_hash"))
    other = members.where(~F.col("train")).select(F.col("id").alias("other_id"), F.col("set_hash").alias("other_hash"))
    with_train = salted(train, linked.select("train_hash", "other_hash", "similarity"), "train_hash", "train_id", total)
    return salted(other, with_train, "other_hash", "other_id", total).where("train_id <> other_id").select("train_id", "other_id", "similarity").distinct()


def counts_of(linked: DataFrame, members: DataFrame) -> DataFrame:
    """(other_id, n, most): for each record that is not train and overlaps, the train records it overlaps and the greatest
    similarity, from the sizes of the classes; no pair of records is made."""
    members = cut(members)
    sizes = members.groupBy("train", "set_hash").agg(F.count(F.lit(1)).alias("n"))
    per = (
        linked.join(sizes.where("train").select(F.col("set_hash").alias("train_hash"), "n"), "train_hash")
        .groupBy("other_hash").agg(F.sum("n").alias("n"), F.max("similarity").alias("most"))
        .join(sizes.where(~F.col("train")).select(F.col("set_hash").alias("other_hash"), F.col("n").alias("members")), "other_hash")
    )
    other = members.where(~F.col("train")).select(F.col("id").alias("other_id"), F.col("set_hash").alias("other_hash"))
    return look_up(other, "other_hash", per, "members", members.count()).groupBy("other_id").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a training record and another that overlap."""
    return pairs_of(*_linked(spark, sf_dir)).select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and source, how many of its records occur in training, and in how many pairs."""
    cases = table(spark, sf_dir, "evaluation_case").select("id", split_of("split").alias("split"), "source").dropDuplicates(["id"])
    found = counts_of(*_linked(spark, sf_dir))
    rows = cases.where("split <> 'train'").join(found.withColumnRenamed("other_id", "id"), "id", "left")
    return rows.groupBy("split", F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.max("most"), F.lit(0.0)).alias("most_similar")
    )
