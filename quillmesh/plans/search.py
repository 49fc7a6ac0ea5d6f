"""Queries over pairs, stores and vectors: scores, duplicates, spam, patterns, postings, candidates, search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import normalize, tokens
from quillmesh.functions import tables as T
from quillmesh.operators import retrieval as R
from quillmesh.operators import scoring as S
from quillmesh.plans.registry import Registry
from quillmesh.runtime import spread, table
from quillmesh.sources import packs

query = Registry()


def _pairs(spark, sf):
    return table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b").dropDuplicates(["id"])


@query()
def cmp_score(spark, sf):
    """All pairs of texts with their channels and score."""
    return S.scored(_pairs(spark, sf)).select("id", *(F.round(c, 6).alias(c) for c in ("lexical", "character", "visual", "phonetic", "obfuscation", "normalized_identity", "substring_containment", "cross_script_pair", "score")))


_CH = "WITH c AS (SELECT vec_id, embedding[1]::DOUBLE AS semantic, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE abs(embedding[2])::DOUBLE END AS lexical, abs(embedding[3])::DOUBLE AS character FROM embeddings)"


def _channels(spark, sf):
    """Three channels from the first dimensions of the vectors, one of them missing at times."""
    e = table(spark, sf, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select("vec_id", at(1).alias("semantic"), F.when(F.col("vec_id") % 3 != 0, F.abs(at(2))).alias("lexical"), F.abs(at(3)).alias("character"))


@query(_CH + " SELECT vec_id, round((0.2 * greatest(0, least(1, semantic)) + CASE WHEN lexical IS NULL THEN 0 ELSE 0.1 * greatest(0, least(1, lexical)) END + 0.1 * greatest(0, least(1, character))) / (0.2 + CASE WHEN lexical IS NULL THEN 0 ELSE 0.1 END + 0.1), 6) AS score FROM c")
def cmp_combine(spark, sf):
    c = _channels(spark, sf)
    return c.select("vec_id", F.round(S.combine({k: F.col(k) for k in ("semantic", "lexical", "character")}), 6).alias("score"))


@query(_CH + " SELECT vec_id, round(1 / (1 + exp(-(0.5 + 2 * semantic + coalesce(lexical, 0) - character))), 6) AS score FROM c")
def cmp_logistic(spark, sf):
    return _channels(spark, sf).select("vec_id", F.round(S.logistic({k: F.col(k) for k in ("semantic", "lexical", "character")}, {"semantic": 2.0, "lexical": 1.0, "character": -1.0}, 0.5), 6).alias("score"))


@query(_CH + ", p AS (SELECT vec_id, greatest(1e-9, least(1 - 1e-9, character)) AS p FROM c) SELECT vec_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.2) / 1.5)), 6) AS score FROM p")
def cmp_profile_calibration(spark, sf):
    c = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("character")))
    return _channels(spark, sf).select("vec_id", F.round(S.calibrated(c, 0.2, 1.5), 6).alias("score"))


@query(_CH + f""", b AS (SELECT vec_id % 10 AS query, vec_id AS id, character AS score, semantic, lexical FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place, 1 / (1 + exp(-({T.RERANK['bias']} + {T.RERANK['base']} * score + {T.RERANK['semantic']} * semantic + {T.RERANK['lexical']} * coalesce(lexical, 0)))) AS second FROM b)
    SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN place <= 5 THEN 0 ELSE 1 END, CASE WHEN place <= 5 THEN -second ELSE place END, id) AS rank FROM r""")
def cmp_rerank(spark, sf):
    rows = _channels(spark, sf).select((F.col("vec_id") % 10).alias("query"), F.col("vec_id").alias("id"), F.col("character").alias("score"), "semantic", "lexical")
    return S.rerank(rows, "query", "score", {"semantic": F.col("semantic"), "lexical": F.col("lexical")}, 5).select("query", "id", "rank")


@query()
def dup_judge(spark, sf):
    pairs = _pairs(spark, sf)
    both = pairs.join(S.scored(pairs), "id")
    return S.judged(both).select("id", "duplicate", F.round("duplicate_score", 6).alias("score"), "reason")


@query("SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1")
def dup_exact(spark, sf):
    return table(spark, sf, "documents").where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(r"WITH n AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS k FROM documents WHERE length(text) > 0) SELECT k, count(*) AS n, min(doc_id) AS first FROM n GROUP BY k HAVING count(*) > 1")
def dup_normalized(spark, sf):
    k = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    return table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query()
def spam_feature_table(spark, sf):
    """The fifteen features of every message."""
    rows = spread(table(spark, sf, "spam_item").where("text IS NOT NULL").select("id", "text"), "id").dropDuplicates(["id"])
    f = S.spam_features(rows, lexicon=packs.from_table(table(spark, sf, "language_pack")))
    return f.select("id", "url_count", "email_count", "emoji_count", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in T.SPAM_WEIGHTS if c not in ("url_count", "email_count", "emoji_count")))


@query(r"""WITH d AS (SELECT id, max(text) AS t FROM spam_item WHERE length(text) > 0 GROUP BY id) SELECT id, round(len(regexp_extract_all(t, '\p{N}')) / length(t), 6) AS number_ratio, round(len(regexp_extract_all(t, '\p{Lu}')) / greatest(1, len(regexp_extract_all(t, '\p{L}'))), 6) AS uppercase_ratio, round(len(regexp_extract_all(t, '[!-/:-@\[-`{-~]')) / length(t), 6) AS punctuation_ratio FROM d""")
def spam_ratios(spark, sf):
    rows = spread(table(spark, sf, "spam_item").where(F.length("text") > 0), "id").groupBy("id").agg(F.max("text").alias("text"))
    return S.spam_features(rows).select("id", *(F.round(c, 6).alias(c) for c in ("number_ratio", "uppercase_ratio", "punctuation_ratio")))


@query()
def spam_predictions(spark, sf):
    """Untrained and trained probability, labels and reasons of every message."""
    rows = spread(table(spark, sf, "spam_item").where("text IS NOT NULL").select("id", "text"), "id").dropDuplicates(["id"])
    f = S.spam_features(rows, lexicon=packs.from_table(table(spark, sf, "language_pack")))
    return f.select("id", F.round(S.spam_heuristic(), 6).alias("heuristic"), F.round(S.spam_trained(), 6).alias("trained"), (S.spam_trained() >= T.SPAM_THRESHOLD).alias("spam"), S.spam_labels().alias("labels"), S.spam_reasons().alias("reasons"))


@query()
def pat_match(spark, sf):
    """Messages that come near an example of a registered pattern."""
    registry = spark.createDataFrame([("claim", ["last chance to claim your prize now"], ["the chance to see you"], 0.3), ("winner", ["congratulations you were chosen"], [], 0.3)], "pattern_id string, examples array<string>, negatives array<string>, threshold double")
    rows = table(spark, sf, "spam_item").where("text IS NOT NULL").select("id", "text").dropDuplicates(["id"])
    return S.match_patterns(rows, registry).select("id", "pattern_id", F.round("score", 6).alias("score"), "matched_example")


_WORDS = r"SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS key FROM documents"


@query(f"WITH p AS ({_WORDS}) SELECT key, count(*) AS n, min(id) AS first FROM p GROUP BY key")
def idx_postings(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    p = docs.select("id", F.explode(F.array_distinct(tokens.words(F.col("text")))).alias("key"))
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


_CAND = f"""WITH p AS ({_WORDS}), q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS key FROM benchmark),
    m AS (SELECT query, key, id, row_number() OVER (PARTITION BY query, key ORDER BY id) AS k FROM q JOIN p USING (key))"""


@query(_CAND + " SELECT query, id, count(*) AS shared FROM m WHERE k <= 200 GROUP BY ALL")
def idx_candidates(spark, sf):
    """Documents that share words with a test item, at most 200 of each posting list as the retrieval has it."""
    keys = lambda name, key, to: table(spark, sf, name).select(F.lit("lexical").alias("channel"), F.explode(F.array_distinct(tokens.words(F.col("text")))).alias("key"), F.col(key).alias(to))
    return R.met_of(keys("documents", "doc_id", "id"), keys("benchmark", "item_id", "query")).select("query", "id", "shared")


@query()
def idx_read_postings(spark, sf):
    """The longest posting lists of the channels that read a text, over the test items."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    p = R.postings(items, R.READ_CHANNELS, packs.from_table(table(spark, sf, "language_pack")))
    return p.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"), F.countDistinct("id").alias("items"))


@query()
def idx_prerank(spark, sf):
    """The 20 best documents for each test item among those that share a word, the normalized text or a trigram with it, the
    first 200 of each posting list as the retrieval has it."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = R.candidates(R.postings(docs), queries)
    return R.preranked(found, queries, docs, 20).select("query", "id", F.round("prerank", 6).alias("prerank"), "rank")


@query("WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 10")
def vec_exact_search(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.exact_search(v, v.where("id % 20 = 0"), 10).select("query", "id", "rank")


@query("SELECT vec_id, list_transform(embedding[1:8], lambda x: round(x::DOUBLE * 10)::INT) AS buckets FROM embeddings")
def vec_buckets(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", R.buckets(F.col("embedding")).alias("buckets"))


@query("SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(spark, sf):
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("p"))
    b = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("x"), F.col("vec_id").alias("y"), F.col("embedding").alias("q"))
    return a.join(b, "x").select("x", "y", F.round(R.cosine(F.col("p"), F.col("q")), 6).alias("cosine"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE 'old' END AS version FROM customer UNION ALL SELECT -1, 'new'")
def sink_upsert(spark, sf):
    """A store after rows of it were replaced and one was added."""
    store = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("version"))
    fresh = store.where("id % 10 = 0").select("id", F.lit("new").alias("version")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("new").alias("version")))
    return R.upsert(store, fresh)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0")
def sink_delete(spark, sf):
    store = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return R.remove(store, store.where("id % 7 = 0"))


@query("SELECT event_id, least(2, greatest(2, event_id % 4)) AS schema_version FROM events WHERE event_id % 4 <= 2")
def src_migrate(spark, sf):
    """Records of older versions stamped anew; newer ones are refused."""
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("schema_version"))
    return R.migrated(rows)[0]


@query("SELECT id, to_json(struct_pack(id := id, label := label)) AS line FROM (SELECT DISTINCT id, label FROM spam_item WHERE label IS NOT NULL)")
def sink_json_lines(spark, sf):
    rows = table(spark, sf, "spam_item").where("label IS NOT NULL").select("id", "label").distinct()
    return rows.select("id", F.to_json(F.struct("id", "label")).alias("line"))
