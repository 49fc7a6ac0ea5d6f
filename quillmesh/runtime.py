"""Session settings, table access, lineage cuts and Arrow batch helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmesh")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset, a folder of our own.

    The fallback lies on the local disk, so it is refused outside ``local`` masters.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillmesh-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor never replays its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of whatever no DataFrame leads to any more, as after a cut in a loop.

    Spark deletes them when the driver's JVM finds their owners unused, which without this may be long after. The scheduler
    holds on to the job that ran last, so a small one takes its place first.
    """
    gc.collect()
    spark.range(default_parallelism(spark)).groupBy(F.col("id") % 3).count().collect()
    for _ in range(3):  # what one run lets go of still holds what only the next can find, once the first is cleaned up
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out to as many partitions as the session shuffles into, which adaptive execution leaves as they are."""
    n = default_parallelism(df.sparkSession)
    return df.repartition(n, *columns) if columns else df.repartition(n)


def even(df: DataFrame) -> DataFrame:
    """``df`` as it is where it is read from at least as many files as the session shuffles into; else dealt out, so that a
    costly Python stage over a few small files does not run in a few tasks. A large table is never shuffled by this."""
    return df if len(df.inputFiles()) >= default_parallelism(df.sparkSession) else spread(df)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Arrow batches through ``fn``; a None or empty result is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            if out is None or out.num_rows == 0:
                continue
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, partition: list[str], order: str, buckets: int = 4096, name: str = "rank") -> DataFrame:
    """1-based rank of each row by the hash of ``order`` within ``partition``, without gathering a partition in one task.

    Rows are first counted per hash bucket; a row's rank is the total of the buckets before its own plus its place
    inside it, so a window only ever sorts one bucket of one partition.
    """
    from pyspark.sql import Window as W

    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(*partition, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*partition).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    inside = bucketed.withColumn("_inside", F.row_number().over(W.partitionBy(*partition, "_bucket").orderBy(F.xxhash64(order), order)))
    return (
        inside.join(before.select(*partition, "_bucket", "_before"), [*partition, "_bucket"])
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
        .drop("_bucket", "_before", "_inside")
    )


def data_bytes(path: str) -> int:
    """Bytes of the local parquet files below ``path``."""
    if os.path.isfile(path):
        return os.path.getsize(path)
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        start = int(key.searchsorted(key[-1], "left"))
        if start == 0 and held and held[-1].column(0)[-1].as_py() == key[-1]:
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, start)]
        if sum(b.num_rows for b in ready):
            yield pa.Table.from_batches(ready)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def sampled(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, drawn by hash of ``key``. Rows beyond a little over ``most`` are dropped where they are read,
    so what reaches the driver does not grow with the number of tasks."""
    rows = df.count()
    if rows > 2 * most:
        part = int(1.2 * most / rows * (1 << 30)) + 1
        df = df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < part)
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most)
