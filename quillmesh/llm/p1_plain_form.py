"""Problem 1: texts with look-alike characters, found and brought to plain form.

:func:`to_plain` adds the plain form of a text column; :func:`with_lookalikes` keeps the rows whose text holds such
characters. Both are narrow: one Arrow pass, no shuffle of texts. Texts of ASCII characters alone never become Python strings.

Null texts give a null plain form and no case; empty texts are their own plain form. Other columns pass through
untouched, under any name but the new one, which must not exist yet.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import MESSAGES, fields
from quillmesh.llm.plain import is_plain, plain
from quillmesh.runtime import map_batches

#: At least one character beyond ASCII; all others are in plain form.
_BEYOND_ASCII = r"[^\x00-\x7F]"


def to_plain(df: DataFrame, text: str, name: str = "plain") -> DataFrame:
    """``df`` with the plain form of column ``text`` as a new last column ``name``."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text))
        # most texts are ASCII and their own plain form; they go on in Arrow and never become Python strings
        ascii_ = pc.fill_null(pc.string_is_ascii(column), True)
        if pc.all(ascii_).as_py() is not False:
            new = column
        else:
            others = pa.array([plain(t) for t in column.filter(pc.invert(ascii_)).to_pylist()], column.type)
            new = pc.replace_with_mask(column, pc.invert(ascii_), others)
        return pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def with_lookalikes(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose ``text`` is not in plain form."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text))
        return batch.filter(pa.array([not is_plain(t) for t in column.to_pylist()], pa.bool_()))

    return map_batches(df.filter(F.col(text).rlike(_BEYOND_ASCII)), run, df.schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that hold look-alike characters."""
    return with_lookalikes(fields(spark, sf_dir, MESSAGES), "text").select("src", "id", "field").distinct()


def p1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of every field, one row for each record and field."""
    return to_plain(fields(spark, sf_dir, MESSAGES), "text").select("src", "id", "field", "plain").distinct()
