"""Queries over the engine as a whole: analysis, pairs with all evidence, retrieval, decisions, fitting, diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmesh.config import EngineConfig
from quillmesh.engine import TextEngine
from quillmesh.functions import tables as T
from quillmesh.functions import tokens
from quillmesh.operators import decide, evidence, measures
from quillmesh.plans import texts
from quillmesh.plans.registry import Registry
from quillmesh.runtime import sampled, spread, table
from quillmesh.sources import packs

query = Registry()
_VOTES = f"WITH votes AS ({texts.query.sql['lang_profile_detect']})"


def _once(df, *keys):
    return df.dropDuplicates(list(keys))


@query()
def engine_analyze(spark, sf):
    """The whole analysis of every message, as counts and scores of its channels."""
    rows = _once(table(spark, sf, "spam_item").where("text IS NOT NULL").select("id", "text"), "id")
    out = TextEngine(spark).analyze(rows, channels=("unicode", "lexical", "symbolic", "phonetic", "transliteration", "entities", "obfuscation"))
    return out.select("id", "too_long", "normalized", F.size("segments").alias("segments"), "simhash", F.size("symbols").alias("symbols"), "phonetic.syllables", F.size("transliterations").alias("views"), F.size("entities").alias("entities"), F.round("obfuscation.score", 6).alias("obfuscation"))


@query()
def engine_decode(spark, sf):
    rows = _once(table(spark, sf, "evaluation_case").where("b IS NOT NULL").select("id", F.col("b").alias("text")), "id")
    return TextEngine(spark).decode(rows).select("id", "rank", "text", F.round("score", 6).alias("score"), "strong")


@query()
def engine_compare(spark, sf):
    """All pairs of texts with every channel, the features between them, and both scores."""
    pairs = _once(spread(table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b"), "id"), "id")
    engine = TextEngine(spark, packs_table=table(spark, sf, "language_pack"))
    out = engine.compare(pairs)
    return out.select("id", *(F.round(c, 6).alias(c) for c in (*T.CHANNELS, *T.PAIR_FEATURES, "channel_confidence", "language_agreement", "score", "trained")))


@query()
def engine_duplicates(spark, sf):
    """Which pairs of texts are duplicates, and why."""
    pairs = _once(spread(table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b"), "id"), "id")
    return TextEngine(spark, packs_table=table(spark, sf, "language_pack")).duplicates(pairs, between=False).select("id", "duplicate", F.round("duplicate_score", 6).alias("score"), "reason")


def _store_and_items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@query()
def engine_find_similar(spark, sf):
    """The three documents most similar to each test item, out of the 20 that come first in retrieval."""
    engine = TextEngine(spark, EngineConfig(search_candidates=20), packs_table=table(spark, sf, "language_pack"))
    return engine.find_similar(*_store_and_items(spark, sf), 3).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query()
def engine_find_duplicates(spark, sf):
    """The documents that come near a test item, by words, out of the 20 that come first in retrieval."""
    engine = TextEngine(spark, EngineConfig(search_candidates=20), packs_table=table(spark, sf, "language_pack"))
    return engine.find_duplicates(*_store_and_items(spark, sf), 0.3, "lexical").select("query", "id", F.round("duplicate_score", 6).alias("score"), "reason")


@query()
def engine_diagnostics(spark, sf):
    return TextEngine(spark).diagnostics()


def _choices(spark, sf):
    rows = table(spark, sf, "decision_example").where("state IS NOT NULL AND question.type = 'choice' AND question.criteria IS NOT NULL")
    return _once(rows.select("id", "state", "gold", "split", F.col("question.criteria").alias("criteria")), "id")


@query()
def dec_similarity_adapter(spark, sf):
    return decide.similarity_decisions(_choices(spark, sf)).select("id", "label", F.round("confidence", 6).alias("confidence"), "decision")


@query()
def dec_spam_adapter(spark, sf):
    """Binary questions about unwanted advertising, answered by the trained spam scorer."""
    rows = _once(spread(table(spark, sf, "decision_example").where("state IS NOT NULL AND question.type = 'binary'").select("id", "state"), "id"), "id")
    out = TextEngine(spark, packs_table=table(spark, sf, "language_pack")).detect_spam(rows, "state")
    p = F.col("probability")
    return out.select("id", F.round(p, 6).alias("probability_true"), (p >= 0.5).alias("answer"), F.when(F.greatest(p, 1 - p) >= 0.5, "accept").otherwise("escalate").alias("decision"))


@query()
def dec_interaction_head(spark, sf):
    """Choice questions decided by a head that was fitted to a bounded sample of labelled ones."""
    rows = _choices(spark, sf)
    sample = sampled(rows.where("gold IS NOT NULL AND lower(split) LIKE 'train%'"), "id", 400).collect()
    examples = []
    for r in sample:
        labels = sorted(r.criteria)
        if r.gold in labels:
            state = tokens.word_hash_texts([r.state] * len(labels), 64)
            examples.append((decide.interaction(state, tokens.word_hash_texts([f"{k} {r.criteria[k]}" for k in labels], 64)).astype(np.float64), labels.index(r.gold)))
    head = decide.fit_head(examples, hidden=16, epochs=4) if examples else decide.Head.fresh(256, 16)
    return decide.head_decisions(rows.select("id", "state", "criteria"), head, 64).select("id", "label", F.round("confidence", 4).alias("confidence"), "decision")


@query()
def dec_fusion_features(spark, sf):
    lexicon = packs.from_table(table(spark, sf, "language_pack"))
    read = evidence.with_message_features(_choices(spark, sf).select("id", "state"), "state", lexicon)
    rows = read.select("id", decide.fusion(F.col("state"), {k: F.col(k) for k in evidence.MESSAGE}).alias("f"))
    return rows.select("id", F.explode("f").alias("feature", "value")).select("id", "feature", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT id, max(state) AS s FROM decision_example WHERE state IS NOT NULL AND question.type = 'choice' AND question.criteria IS NOT NULL GROUP BY id)
    SELECT id, length(s)::DOUBLE AS char_length, round(len(regexp_extract_all(s, '\\p{N}')) / greatest(1, length(s)), 6) AS digit_ratio, len(regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+'))::DOUBLE AS token_count FROM d""".replace("\\\\", "\\"))
def dec_fusion_counts(spark, sf):
    f = _choices(spark, sf).select("id", decide.fusion(F.col("state")).alias("f"))
    return f.select("id", F.col("f")["char_length"].alias("char_length"), F.round(F.col("f")["digit_ratio"], 6).alias("digit_ratio"), F.col("f")["token_count"].alias("token_count"))


@query()
def dec_prototype_blend(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    first = v.groupBy("label").agg(F.min("vector").alias("vector"))
    return decide.prototypes(v, first, 0.3).select("label", F.transform("prototype", lambda x: F.round(x, 6)).alias("prototype"))


@query()
def eval_decisions(spark, sf):
    """Accuracy of the similarity adapter on the labelled choices, by split."""
    rows = _choices(spark, sf).where("gold IS NOT NULL")
    got = decide.similarity_decisions(rows)
    return got.join(rows.select("id", "gold", "split"), "id").groupBy(F.coalesce("split", F.lit("?")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("gold")).cast("double")), 6).alias("accuracy"))


@query(_VOTES + """, k AS (SELECT doc_id, language, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, language) AS k FROM votes),
    g AS (SELECT doc_id, lower(left(lang, 2)) AS gold FROM documents WHERE lang IS NOT NULL), r AS (SELECT doc_id, min(CASE WHEN language = gold THEN k END) AS rank FROM k JOIN g USING (doc_id) GROUP BY 1)
    SELECT count(*) AS n, round(avg(coalesce(rank <= 1, false)::INT), 6) AS top_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS top_3 FROM r""")
def eval_language(spark, sf):
    """Top-1 and top-3 of the language votes against the labels of documents that have one."""
    from quillmesh.plans.texts import lang_profile_detect
    from pyspark.sql import Window as W

    votes = lang_profile_detect(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("probability"), "language")))
    gold = table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", F.lower(F.left("lang", F.lit(2))).alias("gold"))
    rank = votes.join(gold, "doc_id").groupBy("doc_id").agg(F.min(F.when(F.col("language") == F.col("gold"), F.col("k"))).alias("rank"))
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)
    return rank.agg(F.count(F.lit(1)).alias("n"), at(1).alias("top_1"), at(3).alias("top_3"))


@query()
def eval_similarity(spark, sf):
    """Binary metrics of a word overlap against the labels of pairs."""
    from quillmesh.functions import distance

    pairs = _once(table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL AND labels['similar'] IS NOT NULL").select("id", "a", "b", F.col("labels")["similar"].cast("double").alias("label")), "id")
    scored = pairs.select("label", distance.jaccard(F.array_distinct(tokens.words(F.col("a"))), F.array_distinct(tokens.words(F.col("b")))).alias("score"))
    return measures.binary_metrics(scored)
