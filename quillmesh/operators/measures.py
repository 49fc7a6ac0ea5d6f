"""Metrics of scores, rankings and decisions, calibration, gates, and fitting of logistic scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binary_metrics(rows: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC, Brier and calibration error of one table as one row.

    The AUC needs no global order: scores are counted by distinct value first, and the few rows per value are ranked in
    buckets of the score range whose totals go in front.
    """
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    base = rows.select(y.alias("y"), s.alias("s"))
    hit = (F.col("s") >= threshold).cast("double")
    flat = base.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.avg((hit == F.col("y")).cast("double")).alias("accuracy"),
        F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("pp"), F.avg((F.col("s") - F.col("y")) ** 2).alias("brier"),
    )
    binned = base.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg("s").alias("conf"), F.avg("y").alias("rate"))
    ece = binned.agg((F.sum(F.col("c") * F.abs(F.col("conf") - F.col("rate"))) / F.sum("c")).alias("ece"))
    values = base.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("p")).withColumn("b", F.floor(F.col("s") * 1024))
    ahead = values.groupBy("b").agg(F.sum("c").alias("bc")).withColumn("before", F.coalesce(F.sum("bc").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = values.withColumn("within", F.coalesce(F.sum("c").over(W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranks = inside.join(ahead.select("b", "before"), "b").agg(F.sum(F.col("p") * (F.col("before") + F.col("within") + (F.col("c") + 1) / 2)).alias("rank_sum"))
    one = flat.crossJoin(ece).crossJoin(ranks)
    precision, recall = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    neg = F.col("n") - F.col("pos")
    return one.select(
        "n", F.round("accuracy", 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 6).alias("f1"),
        F.round(F.when((F.col("pos") > 0) & (neg > 0), (F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).otherwise(0.0), 6).alias("roc_auc"),
        F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"),
    )


def ranking_metrics(ranked: DataFrame, query: str = "query", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """Recall at 1, 5, 10, MRR and nDCG at 10 with the gain at the first relevant place."""
    first = ranked.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first"))
    at = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    return first.agg(
        F.count(F.lit(1)).alias("queries"), F.round(at(1), 6).alias("recall_1"), F.round(at(5), 6).alias("recall_5"), F.round(at(10), 6).alias("recall_10"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(F.when(F.col("first") <= 10, 1 / F.log2(F.col("first") + 1.0)), F.lit(0.0))), 6).alias("ndcg_10"),
    )


# ------------------------------------------------------------------------------------------------ distributions (arrays of double)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top) / F.lit(temperature)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.ln(v)).otherwise(0.0))


def margin(p: Column) -> Column:
    down = F.reverse(F.array_sort(p))
    return F.when(F.size(p) > 1, F.element_at(down, 1) - F.element_at(down, 2)).otherwise(F.element_at(down, 1))


def expected(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)


def energy(x: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp((v - top) / F.lit(temperature)))
    return -(top + F.lit(temperature) * F.ln(total))


def nll(p_gold: Column) -> Column:
    return -F.ln(F.greatest(p_gold, F.lit(1e-12)))


def brier(p: Column, gold: Column) -> Column:
    """Mean squared error over the classes; ``gold`` counts from 0."""
    return F.aggregate(F.transform(p, lambda v, i: (v - F.when(i == gold, 1.0).otherwise(0.0)) ** 2), F.lit(0.0), lambda s, v: s + v) / F.size(p)


def temperature_grid(points: int = 60, low: float = 0.05, high: float = 5.0) -> list[float]:
    """Temperatures evenly spaced in their logarithm."""
    return [float(low * (high / low) ** (i / (points - 1))) for i in range(points)]


def gates(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds (section, metric, bound min or max, value) that metrics (section, metric, measured) miss; a missing metric misses."""
    joined = bounds.join(metrics, ["section", "metric"], "left")
    ok = F.when(F.col("bound") == "min", F.col("measured") >= F.col("value")).otherwise(F.col("measured") <= F.col("value"))
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------------------------------------ fitting


def fit_logistic(rows: DataFrame, features: list[str], label: str, steps: int = 50, rate: float = 0.5, l2: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by full-batch descent with balanced classes; every step is one aggregate over the table."""
    rows = rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y")).cache()
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
    w_pos, w_neg = 0.5 / max(pos, 1), 0.5 / max(n - pos, 1)
    weights, bias = np.zeros(len(features)), 0.0
    for _ in range(steps):
        z = sum((F.col(f) * float(w) for f, w in zip(features, weights, strict=True)), F.lit(float(bias)))
        error = (1 / (1 + F.exp(-z)) - F.col("_y")) * F.when(F.col("_y") == 1, w_pos).otherwise(w_neg)
        got = rows.select(error.alias("_e"), *features).agg(F.sum("_e"), *(F.sum(F.col("_e") * F.col(f)) for f in features)).first()
        bias -= rate * got[0]
        weights -= rate * (np.array(got[1:], float) + l2 * weights)
    rows.unpersist()
    return [float(w) for w in weights], float(bias)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Each row with half the weight of its class shared among that class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(counts), label).withColumn("weight", 0.5 / F.col("_n")).drop("_n")
