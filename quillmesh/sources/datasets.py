"""Reading and writing of messages, evaluation cases, spam corpora, decisions, patterns, stores and artifacts."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, a string, b string, languages array<string>, split string, difficulty string, category string, labels map<string,boolean>, expected struct<decoded_contains:array<string>,min_similarity:double>, tags array<string>"
DECISION = "id string, state string, question struct<type:string,instructions:string,criteria:map<string,string>,statement:string,levels:array<string>>, gold string, teacher_probabilities map<string,double>, task string"
PATTERN = "id string, examples array<string>, negative_examples array<string>, threshold double, languages array<string>, tags array<string>, enabled_channels array<string>"
STORE_VERSION = 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One message for each line that is not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("text"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON lines or of files ``{version, cases}``; split and difficulty have their defaults."""
    raw = spark.read.option("multiLine", True).schema(f"version string, cases array<struct<{_fields(CASE)}>>, {CASE}").json(path)
    nested = raw.where("cases IS NOT NULL").select(F.explode("cases").alias("c")).select("c.*")
    flat = raw.where("cases IS NULL AND id IS NOT NULL").drop("version", "cases")
    s = F.lower(F.trim("split"))
    split = F.when(s.isin("train", "training"), "train").when(s.isin("validation", "valid", "dev"), "validation").otherwise("test")
    return nested.unionByName(flat).withColumn("split", split).withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))


def _fields(schema: str) -> str:
    """``a string, b map<..>`` as the members of a struct."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def spam_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label) of a corpus file ``{version, source, items}``."""
    raw = spark.read.option("multiLine", True).schema("version string, source string, items array<struct<id:string,text:string,label:string>>").json(path)
    return raw.select(F.explode("items").alias("i")).select("i.id", "i.text", F.lower("i.label").alias("label"))


def decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of decision examples; a bad line could not be read, or lacks what its type needs."""
    raw = spark.read.schema(f"{DECISION}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())
    q = F.col("question")
    whole = F.when(q["type"] == "choice", F.size(q["criteria"]) >= 2).when(q["type"] == "binary", F.length(F.trim(q["statement"])) > 0).when(q["type"] == "score", F.size(q["levels"]) >= 2).otherwise(False)
    ok = F.col("_bad").isNull() & (F.length(F.trim("id")) > 0) & (F.length(F.trim("state")) > 0) & F.coalesce(whole, F.lit(False))
    return raw.where(ok).drop("_bad", "_file"), raw.where(~F.coalesce(ok, F.lit(False))).select("_file", "_bad", "id")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store table, refused when a record is of a newer version."""
    rows = spark.read.parquet(path)
    newer = rows.where(F.coalesce(F.col("store_version"), F.lit(1)) > STORE_VERSION).limit(1).count() if "store_version" in rows.columns else 0
    if newer:
        raise ValueError(f"the store is newer than version {STORE_VERSION}")
    return rows


def write_store(rows: DataFrame, path: str) -> None:
    """Writes beside the old table first, then swaps the folders, so a reader sees one or the other."""
    staging, old = f"{path}.new", f"{path}.old"
    rows.withColumn("store_version", F.lit(STORE_VERSION)).write.mode("overwrite").parquet(staging)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(jvm.java.net.URI(path if ":" in path else f"file://{os.path.abspath(path)}"), spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(staging), at(path))
    fs.delete(at(old), True)


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an envelope ``{schema_version, patterns}``; blank ids, no examples or thresholds beyond 0 and 1 are refused."""
    raw = spark.read.option("multiLine", True).schema(f"schema_version int, patterns array<struct<{_fields(PATTERN)}>>").json(path)
    rows = raw.select(F.explode("patterns").alias("p")).select("p.*").withColumn("threshold", F.coalesce("threshold", F.lit(0.75)))
    bad = rows.where((F.length(F.trim(F.coalesce("id", F.lit("")))) == 0) | (F.coalesce(F.size("examples"), F.lit(0)) < 1) | ~F.col("threshold").between(0, 1)).limit(1).count()
    if bad:
        raise ValueError("a pattern needs an id, an example and a threshold within 0 and 1")
    return rows.select(F.col("id").alias("pattern_id"), "examples", F.coalesce("negative_examples", F.array().cast("array<string>")).alias("negatives"), "threshold", "languages", "tags", "enabled_channels")


def save_patterns(rows: DataFrame, path: str) -> None:
    """A registry is small by its own limit, so it is one file."""
    kept = [r.asDict(recursive=True) for r in rows.select(F.col("pattern_id").alias("id"), "examples", F.col("negatives").alias("negative_examples"), "threshold").limit(10_001).collect()]
    if len(kept) > 10_000:
        raise ValueError("a registry holds at most 10,000 patterns")
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump({"schema_version": 1, "patterns": kept}, f, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def artifact(path: str, kind: str, names: list[str]) -> tuple[dict[str, float], float]:
    """Weights and bias of a logistic artifact; other kinds, versions, features or numbers that are not finite are refused."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.get("kind") != kind or raw.get("artifact_version") != 1:
        raise ValueError(f"not a {kind} artifact of version 1")
    weights, bias = raw.get("weights") or {}, raw.get("bias")
    if set(weights) != set(names):
        raise ValueError(f"the features differ: {sorted(set(weights) ^ set(names))}")
    if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in [*weights.values(), bias]):
        raise ValueError("weights and bias must be finite")
    return {k: float(v) for k, v in weights.items()}, float(bias)


def save_artifact(path: str, kind: str, weights: dict[str, float], bias: float) -> None:
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump({"artifact_version": 1, "kind": kind, "weights": weights, "bias": bias}, f, indent=1)
    os.replace(f"{path}.new", path)


def balanced_decisions(rows: DataFrame, text: str, label: str, per_class: int) -> DataFrame:
    """A sample of decisions with as many examples of each class, drawn by hash: a sampling operator."""
    from pyspark.sql import Window as W

    placed = rows.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(F.md5(text))))
    return placed.where(F.col("_k") <= per_class).select(F.sha2(text, 256).alias("id"), F.col(text).alias("state"), F.col(label).alias("gold"))
