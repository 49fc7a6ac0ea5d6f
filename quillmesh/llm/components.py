"""Connected components of an edge table by parallel hooking and shortcutting.

Each round, every node hooks to its least neighbour if that is less than itself, parents are shortcut to grandparents
until nothing moves, and the edges are rewritten between the parents; the edges that are left shrink by a factor each
round. The parent tables of the rounds are then joined, last to first. Every round is cut in the checkpoint folder.

Nodes that a large part of all edges meet (a hub) would make one partition of a shuffled join huge. Degrees are known
from hooking, so rows of such nodes are looked up in a broadcast table instead; at most ``HUBS`` nodes can hold one part
in ``HUBS`` of all edge ends, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import cut

#: At most so many nodes (or keys) count as hubs.
HUBS = 1000
#: No node of fewer rows than this is a hub.
HUB_ROWS = 20_000


def look_up(rows: DataFrame, key: str, values: DataFrame, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``values``, which holds each ``key`` once and in ``weight`` how many rows have it.

    The keys of at least one part in ``HUBS`` of the ``total`` weight go by broadcast (there are at most ``HUBS``), all
    others by shuffle.
    """
    least = max(HUB_ROWS, -(-total // HUBS))
    if total < HUB_ROWS:
        return rows.join(values.drop(weight), key)
    hubs = values.where(F.col(weight) >= least).drop(weight)
    rest = values.where(F.col(weight) < least).drop(weight)
    by_hub = rows.join(F.broadcast(hubs), key)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key)
    return by_hub.unionByName(others)


def salted(many: DataFrame, other: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """``many`` (``total`` rows) joined with ``other`` on ``key``, where both may have any number of rows for a key.

    Of the keys that hold at least one part in ``HUBS`` of ``many``, each row draws one of so many salts that about
    ``HUB_ROWS`` share one, by column ``by``, and the rows of ``other`` are repeated for each salt.
    """
    if total < HUB_ROWS:
        return many.join(other, key)
    least = max(HUB_ROWS, -(-total // HUBS))
    hot = cut(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key, (1 + F.col("_n") / HUB_ROWS).cast("int").alias("_salts")))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    repeated = other.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")


def _parents_of(parents: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """``parents`` (with a column parent) and for each row what ``known`` (parent, above) says of its parent, else the parent.

    A parent may have any number of children, so its children are counted first and looked up by that.
    """
    children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("_n"))
    above = children.join(known, "parent", "left").select("parent", F.coalesce("above", "parent").alias("above"), "_n")
    return look_up(parents, "parent", above, "_n", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u and v); root is the least node of its component.

    Edges may repeat, point both ways or to themselves; a null end relates nothing. No edges give no rows.
    """
    edges = cut(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    alone = edges.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("parent"))
    edges = edges.where(F.col("u") != F.col("v"))
    rounds: list[tuple[DataFrame, int]] = []
    left = edges.count()
    while left:
        ends = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("parent"), F.count(F.lit(1)).alias("degree"))
        hooked = cut(hooked)
        while True:  # shortcut
            known = hooked.select(F.col("u").alias("parent"), F.col("parent").alias("above"))
            jumped = cut(_parents_of(hooked, known, 2 * left).select("u", F.col("above").alias("parent"), "degree", (F.col("above") != F.col("parent")).alias("moved")))
            hooked, moved = jumped.drop("moved"), jumped.where("moved").limit(1).count()
            if not moved:
                break
        rounds.append((hooked.select(F.col("u").alias("node"), "parent"), 2 * left))
        parents = hooked.select("u", "parent", "degree")
        by_u = look_up(edges, "u", parents, "degree", 2 * left).select(F.col("parent").alias("pu"), "v")
        by_v = look_up(by_u, "v", parents.withColumnRenamed("u", "v"), "degree", 2 * left).select("pu", F.col("parent").alias("pv"))
        edges = cut(by_v.where(F.col("pu") != F.col("pv")).select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct())
        left = edges.count()
    if not rounds:
        return alone.select("node", F.col("parent").alias("root")).distinct()
    roots, _ = rounds.pop()
    while rounds:
        known = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        own, total = rounds.pop()
        roots = _parents_of(own, known, total).select("node", F.col("above").alias("parent"))
    found = roots.select("node", F.col("parent").alias("root"))
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("parent").alias("root")))
