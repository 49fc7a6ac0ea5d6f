"""Fields of the tables as rows of (src, id, field, text), each record once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.runtime import table


def fields(spark: SparkSession, sf_dir: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """One row for each delivery of each field: src, id, field, text. Repeated deliveries hold the same text."""
    parts = [table(spark, sf_dir, src).select(F.lit(src).alias("src"), "id", F.lit(field).alias("field"), F.col(field).alias("text")) for src, field in wanted]
    return reduce(DataFrame.unionAll, parts)


MESSAGES = [("evaluation_case", "a"), ("evaluation_case", "b"), ("spam_item", "text")]
