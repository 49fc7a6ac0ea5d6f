"""Problem 6: splits in which no two related records are parted.

Records that share a key (author, source or a mentioned account) are edges to the least record of that key, so a key of
any size gives as many edges as it has records, never pairs. Their components come from hooking and shortcutting
(:mod:`quillmesh.llm.components`). The sizes of the groups, with how many there are of each, are few however many
groups there are (``k`` sizes need ``k * (k + 1) / 2`` records); over them bitsets of reachable sums choose how many
groups of each size go to test and to validation, in each category apart.

Defined results: null and blank authors and sources and texts without accounts relate nothing, such records are groups
of one; repeated deliveries are one record, and where they differ in a field all their values count; ties between
categories of a group go to the first in order; empty tables give no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.components import components, look_up
from quillmesh.runtime import cut, ranked, table

#: An account: @ at a word's start and 3 to 30 letters, digits or underscores; no part of an email address.
ACCOUNT = r"(?<![\p{L}\p{N}_.])@([\p{L}\p{N}_]{3,30})(?![\p{L}\p{N}_])"
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SHARES = {"test": 0.1, "validation": 0.1}
#: Sums that the bitsets tell apart; groups beyond them are first dealt out in proportion.
SUMS = 1 << 22
#: Categories that are strata of their own; all others, the smallest, share as many more by hash.
STRATA = 1_000


def split_of(column: str) -> F.Column:
    """The split a label stands for; whatever is not train or validation is test."""
    name = F.lower(F.trim(F.col(column)))
    return F.when(name.isin("train", "training"), "train").when(name.isin("validation", "valid", "dev"), "validation").otherwise("test")


def relations(cases: DataFrame) -> DataFrame:
    """(id, key) of whatever may relate records, with the kind of key before it."""
    trimmed = lambda c: F.lower(F.regexp_replace(F.col(c), _OUTER, ""))
    author = cases.select("id", F.regexp_replace(trimmed("author"), "^@", "").alias("key")).where("key <> ''").select("id", F.concat(F.lit("author "), "key").alias("key"))
    source = cases.select("id", trimmed("source").alias("key")).where("key <> ''").select("id", F.concat(F.lit("source "), "key").alias("key"))
    account = cases.where(F.col("a").contains("@")).select("id", F.explode(F.regexp_extract_all("a", F.lit(ACCOUNT), 1)).alias("key")).select("id", F.concat(F.lit("account "), F.lower("key")).alias("key"))
    return author.unionByName(source).unionByName(account).where(F.col("id").isNotNull())


def groups(keys: DataFrame) -> DataFrame:
    """(id, group_id) of the records of ``keys`` (id, key) that a key relates to another record."""
    keys = cut(keys.distinct())
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = look_up(keys, "key", first, "n", keys.count()).select(F.col("id").alias("u"), F.col("first").alias("v"))
    return components(edges).select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def choose(counts: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their sizes add up to ``target`` as nearly as can be.

    ``counts`` holds each size and its number of groups. A bitset of reachable sums grows by one power-of-two bundle of a
    size at a time, and is read backwards from the reachable sum closest to the target (the smaller of two). Going back
    needs the bitset before each bundle; one in every so many is kept, those between are made again from it.

    Beyond ``SUMS`` a proportional part of each size is taken first. Of what is left, groups of at most the size of the
    target that is left can be added one by one until they pass it, so where these are enough to pass it the total is off
    by at most half the size of the largest of them.
    """
    total = sum(s * n for s, n in counts)
    if not total or target <= 0:
        return {}
    taken = {}
    if target > SUMS:
        part = (target - SUMS // 2) / total
        taken = {s: int(n * part) for s, n in counts}
        target -= sum(s * n for s, n in taken.items())
    limit = 2 * target  # no sum beyond it is closer than none at all
    window = (1 << limit + 1) - 1
    bundles = []
    for size, n in sorted(counts, reverse=True):
        n, bundle = min(n - taken.get(size, 0), limit // size), 1
        while n > 0:
            bundles.append((size, min(bundle, n)))
            n, bundle = n - bundle, bundle * 2
    step, reach, kept = max(1, math.isqrt(len(bundles))), 1, []
    for i, (size, k) in enumerate(bundles):
        if i % step == 0:
            kept.append(reach)
        reach |= reach << size * k & window
    best = min((s for s in (_below(reach, target), _above(reach, target)) if s is not None), key=lambda s: (abs(s - target), s))
    for start in range((len(bundles) - 1) // step * step, -1, -step) if bundles else ():
        before = [kept.pop()]
        for size, k in bundles[start : start + step - 1]:
            before.append(before[-1] | before[-1] << size * k & window)
        for (size, k), reach in zip(bundles[start : start + step][::-1], before[: len(bundles) - start][::-1], strict=True):
            if not reach >> best & 1:
                taken[size] = taken.get(size, 0) + k
                best -= size * k
    return {s: n for s, n in taken.items() if n}


def _below(reach: int, target: int) -> int:
    return (reach & (1 << target + 1) - 1).bit_length() - 1


def _above(reach: int, target: int) -> int | None:
    rest = reach >> target
    return target + (rest & -rest).bit_length() - 1 if rest else None


def assign(records: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``records`` (id, group_id, category) with a new split for each group; what is left after ``shares`` is train.

    The largest ``STRATA`` categories are balanced each on its own, all others in ``STRATA`` lots by hash, so that what the
    driver sees stays small whatever the categories are.
    """
    spark = records.sparkSession
    records = records.withColumn("category", F.coalesce("category", F.lit("")))
    large = records.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(STRATA + 1)
    large = cut(large)
    if large.count() > STRATA:
        named = large.orderBy(F.desc("n"), "category").limit(STRATA).select("category", F.concat(F.lit("own "), "category").alias("stratum"))
        lot = F.concat(F.lit("lot "), F.pmod(F.xxhash64("category"), F.lit(STRATA)).cast("string"))
        records = records.join(F.broadcast(named), "category", "left").withColumn("category", F.coalesce("stratum", lot)).drop("stratum")
    per = records.groupBy("group_id", "category").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("group_id").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "category")).getField("category").alias("stratum"))
    whole = cut(whole)
    sizes = whole.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # few: see above
    quota, missing = [], dict.fromkeys(shares, 0)
    strata: dict[str, dict[int, int]] = {}
    for r in sizes:
        strata.setdefault(r.stratum, {})[r.size] = r.n
    total = lambda rest: sum(s * n for s, n in rest.items())
    # categories with large groups come first, so what they can't give exactly the others make up for
    for stratum in sorted(strata, key=lambda k: (-max(strata[k]) / total(strata[k]), k)):
        rest, whole_, before = strata[stratum], total(strata[stratum]), dict.fromkeys(strata[stratum], 0)
        for split, share in shares.items():
            target = share * whole_ + missing[split]
            taken = choose(sorted(rest.items()), round(target))
            for size, n in taken.items():
                quota.append((stratum, size, split, before[size] + 1, before[size] + n))
                before[size] += n
                rest[size] -= n
            missing[split] = target - total(taken)
    places = ranked(whole, ["stratum", "size"], "group_id", name="place")
    if quota:
        frame = spark.createDataFrame(pd.DataFrame(quota, columns=["stratum", "size", "split", "low", "high"]), "stratum string, size bigint, split string, low bigint, high bigint")
        hit = (places["stratum"] == frame["stratum"]) & (places["size"] == frame["size"]) & places["place"].between(frame["low"], frame["high"])
        chosen = places.join(frame, hit, "left").select("group_id", places["size"], F.coalesce(frame["split"], F.lit("train")).alias("split"))
    else:
        chosen = places.select("group_id", "size", F.lit("train").alias("split"))
    return look_up(records.select("id", "group_id"), "group_id", chosen, "size", sum(r.size * r.n for r in sizes)).select("id", "group_id", "split")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of groups that more than one split holds now."""
    cases = table(spark, sf_dir, "evaluation_case").select("id", "a", "author", "source", "split")
    found = groups(relations(cases)).join(cases.select("id", split_of("split").alias("split")).distinct(), "id")
    found = cut(found.select("id", "group_id", "split"))
    parted = found.groupBy("group_id").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("group_id", "n")
    return look_up(found, "group_id", parted, "n", found.count()).select("id", "group_id").distinct()


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new split for every record."""
    cases = table(spark, sf_dir, "evaluation_case").select("id", "a", "author", "source", "category")
    all_ = cases.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.nullif(F.col("category"), F.lit(""))).alias("category"))
    return assign(all_.join(groups(relations(cases)), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), "category"))
