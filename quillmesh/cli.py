"""``python -m quillmesh.cli COMMAND``: the engine on files of lines, answers as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import __version__
from quillmesh.engine import SCHEMA_VERSION, TextEngine
from quillmesh.runtime import local_session
from quillmesh.sources import datasets, packs


def _show(df: DataFrame, out: str | None) -> None:
    """Written where a folder is named; else the rows pass one by one, never as a whole."""
    if out:
        df.write.mode("overwrite").json(out)
        return
    for row in df.toJSON().toLocalIterator():
        print(row)


def _messages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.text:
        return spark.createDataFrame([(str(i), t) for i, t in enumerate(args.text)], "id string, text string")
    return datasets.lines(spark, args.file).select(F.monotonically_increasing_id().cast("string").alias("id"), "text")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmesh", description=__doc__)
    parser.add_argument("command", choices=["analyze", "batch", "explain", "decode", "compare", "duplicate", "spam", "search", "resources", "diagnostics", "provider-info", "schema-version", "classify", "decide", "eval-decision"])
    parser.add_argument("text", nargs="*")
    parser.add_argument("--file")
    parser.add_argument("--store", help="folder of a table with id and text")
    parser.add_argument("--resource-root", default=packs.EMBEDDED)
    parser.add_argument("--threshold", type=float, default=0.85)
    parser.add_argument("--mode", default="combined")
    parser.add_argument("--profile", default="general_similarity")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    if args.command == "schema-version":
        print(json.dumps({"api": __version__, "schema": SCHEMA_VERSION}))
        return 0
    spark = SparkSession.getActiveSession() or local_session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = TextEngine(spark, resources=args.resource_root)
    if args.command in ("diagnostics", "provider-info"):
        _show(engine.diagnostics(), args.out)
    elif args.command == "resources":
        _show(engine.resource_manifest(), args.out)
    elif args.command in ("analyze", "batch", "explain"):
        _show(engine.analyze(_messages(spark, args)), args.out)
    elif args.command == "decode":
        _show(engine.decode(_messages(spark, args)), args.out)
    elif args.command == "spam":
        _show(engine.detect_spam(_messages(spark, args)), args.out)
    elif args.command in ("compare", "duplicate"):
        if len(args.text) != 2:
            parser.error("two texts are needed")
        pair = spark.createDataFrame([("0", *args.text)], "id string, a string, b string")
        _show(engine.compare(pair, args.profile) if args.command == "compare" else engine.duplicates(pair, args.mode), args.out)
    elif args.command == "search":
        _show(engine.find_similar(datasets.read_store(spark, args.store), _messages(spark, args), args.limit), args.out)
    else:
        good, _ = datasets.decisions(spark, args.file)
        requests = good.where("question.type = 'choice'").select("id", "state", F.col("question.criteria").alias("criteria"), "gold")
        got = engine.decide(requests)
        if args.command == "eval-decision":
            got = got.join(requests.select("id", "gold"), "id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("gold")).cast("double")).alias("accuracy"))
        _show(got, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
