"""Scores of pairs and messages from evidence columns: blends, logistic scorers, second ranking, duplicates, spam, patterns."""

from __future__ import annotations

import pickle
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from quillmesh.functions import distance, normalize, points, rebus, sounds, tokens
from quillmesh.functions import tables as T
from quillmesh.functions import unicode as uni
from quillmesh.functions.rebus import Search
from quillmesh.runtime import map_batches
from quillmesh.sources.packs import Lexicon


def combine(channels: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the channels that are there; a missing one takes its weight along."""
    weights = weights or T.PROFILES["general_similarity"]
    there = {k: c for k, c in channels.items() if weights.get(k, 0) > 0}
    clean = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(c.cast("double"), F.lit(0.0)))) for k, c in there.items()}
    total = sum((F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in there.items()), F.lit(0.0))
    value = sum((F.when(there[k].isNotNull(), c * F.lit(weights[k])).otherwise(0.0) for k, c in clean.items()), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(0.0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), c))))


def calibrated(raw: Column, bias: float = 0.0, temperature: float = 1.0) -> Column:
    """A score moved by ``bias`` and divided by ``temperature`` on the logit scale."""
    eps = 2.220446049250313e-16
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), raw))
    logit = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.ln(p / (1 - p)) + F.lit(bias)))
    return 1 / (1 + F.exp(-logit / F.lit(temperature)))


def logistic(features: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    """Logistic score; a missing feature counts as zero."""
    return sigmoid(sum((F.coalesce(features[k].cast("double"), F.lit(0.0)) * F.lit(w) for k, w in weights.items() if k in features), F.lit(bias)))


def rerank(df: DataFrame, query: str, score: str, channels: dict[str, Column], most: int) -> DataFrame:
    """The first ``most`` rows of each query ordered anew by the second score, the rest behind them in their order."""
    blend = sum((F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(T.RERANK[k]) for k, c in channels.items() if k in T.RERANK), F.lit(T.RERANK["bias"])) + F.col(score) * F.lit(T.RERANK["base"])
    placed = df.withColumn("_place", F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), "id"))).withColumn("rerank_score", sigmoid(blend))
    head = F.when(F.col("_place") <= most, 0).otherwise(1)
    order = W.partitionBy(query).orderBy(head, F.when(head == 0, -F.col("rerank_score")).otherwise(F.col("_place").cast("double")), "id")
    return placed.withColumn("rank", F.row_number().over(order)).drop("_place")


def channels_of(a: Column, b: Column) -> dict[str, Column]:
    """The channels that two texts alone give: lexical, character, visual, phonetic, obfuscation."""
    words = lambda c: F.array_distinct(F.transform(tokens.words(normalize.strip_marks(normalize.fold(c))), tokens.lemma))
    even = lambda c: normalize.blanks(normalize.collapse(normalize.leet(c)))
    return {
        "lexical": distance.jaccard(words(a), words(b)),
        "character": distance.character(a, b),
        "visual": distance.character(normalize.skeleton(a), normalize.skeleton(b)),
        "phonetic": sounds.phonetic_similarity(a, b),
        "obfuscation": distance.character(even(a), even(b)),
    }


def scored(pairs: DataFrame, a: str = "a", b: str = "b", profile: str = "general_similarity", keep: list[str] | None = None) -> DataFrame:
    """Pairs with their channels, gates and blended score."""
    keep = keep if keep is not None else [c for c in pairs.columns if c not in (a, b)]
    both = pairs.select(*keep, a, b, *(c.alias(k) for k, c in channels_of(F.col(a), F.col(b)).items()))
    fold_a, fold_b = (normalize.letters_only(normalize.fold(F.col(x))) for x in (a, b))
    return both.select(
        *keep,
        *(F.col(k) for k in ("lexical", "character", "visual", "phonetic", "obfuscation")),
        ((fold_a == fold_b) & (fold_a != "")).cast("double").alias("normalized_identity"),
        (F.least(F.length(fold_a), F.length(fold_b)) >= 3).__and__(fold_a.contains(fold_b) | fold_b.contains(fold_a)).cast("double").alias("substring_containment"),
        (~F.arrays_overlap(uni.scripts(F.col(a)), uni.scripts(F.col(b))) & (F.size(uni.scripts(F.col(a))) > 0) & (F.size(uni.scripts(F.col(b))) > 0)).cast("double").alias("cross_script_pair"),
        combine({k: F.col(k) for k in ("lexical", "character", "visual", "phonetic", "obfuscation")}, T.PROFILES[profile]).alias("score"),
    )


def judged(pairs: DataFrame, threshold: float = 0.85, mode: str = "combined") -> DataFrame:
    """Whether pairs (a, b, and the channels of :func:`scored`) are duplicates, and why."""
    same, near = F.col("a") == F.col("b"), normalize.normalized(F.col("a")) == normalize.normalized(F.col("b"))
    by = {"combined": F.col("score"), "near_exact": F.greatest("character", "obfuscation"), "lexical": F.col("lexical"), "phonetic": F.col("phonetic"), "visual": F.col("visual")}[mode]
    equal = same | near if mode in ("combined", "near_exact") else same
    reason = F.when(same, "exact raw match").when(near & F.lit(mode in ("combined", "near_exact")), "normalized match").otherwise(f"{mode} similarity")
    value = F.when(equal, 1.0).otherwise(F.coalesce(by, F.lit(0.0)))
    return pairs.withColumn("duplicate_score", value).withColumn("duplicate", value >= threshold).withColumn("reason", reason)


def spam_features(df: DataFrame, text: str = "text", lexicon: Lexicon | None = None, search: Search = Search(), patterns: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The fifteen spam features of a text column beside the other columns, all null for a null text.

    ``lexicon`` gives the readings (the packs of the package where none is given), ``patterns`` the registry whose best
    match by ``key`` is the pattern score; without one it is 0.
    """
    from quillmesh.sources import packs

    sent = pickle.dumps(lexicon or packs.load())
    held: list[Lexicon] = []
    search = replace(search, kept=1)  # only the best reading counts
    kinds = {"url_count": IntegerType(), "email_count": IntegerType(), "emoji_count": IntegerType(), "confusable_count": IntegerType(), "leet_or_twins": BooleanType(), "length": IntegerType()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(pickle.loads(sent))
        column = batch.column(batch.schema.get_field_index(text))
        texts, none = column.to_pylist(), np.asarray(column.is_null())
        new = {k: pa.array(v, mask=none) for k, v in points.spam_columns(texts).items()}
        read = [None if t is None else max((r["score"] for r in rebus.decode_text(t, held[0], search)), default=0.0) for t in texts]
        return pa.RecordBatch.from_arrays([*batch.columns, *new.values(), pa.array(read, pa.float64())], names=[*batch.schema.names, *new, "decoded_similarity"])

    # one pass over Arrow batches: whatever is done with the features later reads no text again
    names = ["url_count", "email_count", "emoji_count", "number_ratio", "emoji_ratio", "uppercase_ratio", "punctuation_ratio", "entropy", "repetition_score", "obfuscation_score", "mixed_scripts", "confusable_count", "leet_or_twins", "length", "decoded_similarity"]
    schema = StructType(list(df.schema.fields))
    for k in names:
        schema = schema.add(k, kinds.get(k, DoubleType()))
    out = map_batches(df, run, schema)
    if patterns is None:
        return out.withColumn("pattern_score", F.lit(0.0)).withColumn("semantic_pattern_similarity", F.lit(0.0))
    met = match_patterns(df.select(F.col(key).alias("id"), F.col(text).alias("text")), patterns).groupBy("id").agg(F.max("score").alias("pattern_score")).withColumnRenamed("id", key)
    return out.join(met, key, "left").withColumn("pattern_score", F.coalesce("pattern_score", F.lit(0.0))).withColumn("semantic_pattern_similarity", F.col("pattern_score"))


def spam_heuristic() -> Column:
    """The untrained spam probability over :func:`spam_features`."""
    part = lambda name, each, most: F.least(F.col(name) * F.lit(each), F.lit(most))
    value = (
        F.lit(0.05) + part("url_count", 0.22, 0.44) + part("email_count", 0.10, 0.20) + part("emoji_ratio", 0.6, 0.18) + part("number_ratio", 0.5, 0.15)
        + F.col("obfuscation_score") * 0.30 + F.col("repetition_score") * 0.20 + F.col("pattern_score") * 0.25
        + part("uppercase_ratio", 0.08, 0.08) + part("punctuation_ratio", 0.12, 0.12)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def spam_labels() -> Column:
    """What speaks for spam, by name; a message that is likely spam for no one reason is suspicious."""
    found = F.array_compact(
        F.array(
            F.when(F.col("url_count") > 0, "promotion"),
            F.when(F.col("leet_or_twins"), "obfuscated"),
            F.when(F.col("repetition_score") > 0.08, "flooding"),
            F.when(F.col("pattern_score") >= 0.75, "known_pattern"),
            F.when((F.col("emoji_count") >= 2) | (F.col("number_ratio") > 0.20), "attention_grabbing"),
            F.when((F.col("entropy") > 4.5) & (F.col("length") >= 12), "high_entropy"),
        )
    )
    return F.when((F.size(found) == 0) & (spam_heuristic() >= 0.5), F.array(F.lit("suspicious"))).otherwise(found)


def spam_trained() -> Column:
    """The trained spam probability over :func:`spam_features`."""
    return logistic({k: F.col(k) for k in T.SPAM_WEIGHTS}, T.SPAM_WEIGHTS, T.SPAM_BIAS)


def spam_reasons(most: int = 3) -> Column:
    """The features that speak most for spam, strongest first."""
    parts = F.array(*(F.struct((F.col(k) * F.lit(w)).alias("part"), F.lit(k).alias("name")) for k, w in T.SPAM_WEIGHTS.items()))
    return F.transform(F.slice(F.array_sort(F.filter(parts, lambda p: p["part"] > 0), lambda x, y: F.when(x["part"] > y["part"], -1).when(x["part"] < y["part"], 1).otherwise(0)), 1, most), lambda p: p["name"])


def pair_score(weights: dict[str, float] | None = None, bias: float = T.PAIR_BIAS, temperature: float = T.PAIR_TEMPERATURE) -> Column:
    """The trained score of pairs over the columns of :func:`quillmesh.operators.evidence.with_evidence`."""
    weights = weights or T.PAIR_WEIGHTS
    total = sum((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * F.lit(w) for k, w in weights.items()), F.lit(bias))
    return sigmoid(total / F.lit(temperature))


def match_patterns(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Messages (id, text) against patterns (pattern_id, examples, negatives, threshold): the best example of each that
    reaches its threshold. Patterns are a registry of the user's, checked to be small before they are broadcast."""
    size = patterns.agg(F.sum(F.size("examples") + F.size("negatives"))).first()[0] or 0
    if size > 10_000:
        raise ValueError("a registry holds at most 10,000 examples")
    folded = lambda c: F.array_distinct(F.transform(tokens.words(normalize.strip_marks(normalize.fold(c))), tokens.lemma))
    query = messages.select("id", normalize.normalized(F.col("text")).alias("q"))
    examples = patterns.select("pattern_id", "threshold", F.explode("examples").alias("example"), F.lit(False).alias("negative")).unionByName(patterns.select("pattern_id", "threshold", F.explode("negatives").alias("example"), F.lit(True).alias("negative")))
    met = query.join(F.broadcast(examples))
    score = 0.45 * distance.character(F.col("q"), F.col("example")) + 0.30 * distance.jaccard(folded(F.col("q")), folded(F.col("example"))) + 0.25 * distance.character(normalize.skeleton(F.col("q")), normalize.skeleton(F.col("example")))
    best = met.select("id", "pattern_id", "threshold", "example", "negative", score.alias("s")).groupBy("id", "pattern_id", "threshold").agg(
        F.max(F.when(~F.col("negative"), F.col("s"))).alias("best"), F.max_by(F.when(~F.col("negative"), F.col("example")), F.when(~F.col("negative"), F.col("s"))).alias("matched_example"), F.coalesce(F.max(F.when(F.col("negative"), F.col("s"))), F.lit(0.0)).alias("negative_score")
    )
    return best.withColumn("score", F.greatest(F.lit(0.0), F.col("best") - F.col("negative_score") * 0.5)).where("score >= threshold").select("id", "pattern_id", "score", "matched_example", "negative_score")
