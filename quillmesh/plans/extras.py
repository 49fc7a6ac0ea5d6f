"""Queries for the smaller operators: look-ups, resolved symbols, profiles, approximate search, more metrics and joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import tokens
from quillmesh.operators import measures as M
from quillmesh.operators import retrieval as R
from quillmesh.plans.measures import _DEC, _PRED, _predicted
from quillmesh.plans.registry import Registry
from quillmesh.plans.texts import _LEX, _lexicon
from quillmesh.runtime import table
from quillmesh.sources import datasets, packs

query = Registry()


@query("""WITH x AS (SELECT language, unnest(examples) AS t FROM language_pack), p AS (SELECT language, unnest(list_transform(range(1, length(t) - 1), lambda i: lower(substr(t, i, 3)))) AS g FROM x WHERE length(t) >= 3),
    pn AS (SELECT language, g, count(*) AS n FROM p GROUP BY ALL), pl AS (SELECT language, sqrt(sum(n * n)) AS l FROM pn GROUP BY 1),
    d AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(substr(text, i, 3)))) AS g FROM benchmark WHERE length(text) >= 3), dn AS (SELECT item_id, g, count(*) AS n FROM d GROUP BY ALL), dl AS (SELECT item_id, sqrt(sum(n * n)) AS l FROM dn GROUP BY 1)
    SELECT item_id, language, round(sum(dn.n * pn.n) / (any_value(dl.l) * any_value(pl.l)), 6) AS cosine FROM dn JOIN pn USING (g) JOIN dl USING (item_id) JOIN pl USING (language) GROUP BY ALL""")
def lang_ngram_detect(spark, sf):
    """Cosine of each test item's trigrams with the profile of each language."""
    grams = lambda c: F.explode(tokens.char_ngrams(F.lower(c), 3)).alias("g")
    pn = table(spark, sf, "language_pack").select("language", F.explode("examples").alias("t")).where(F.length("t") >= 3).select("language", grams(F.col("t"))).groupBy("language", "g").agg(F.count(F.lit(1)).alias("pn"))
    dn = table(spark, sf, "benchmark").where(F.length("text") >= 3).select("item_id", grams(F.col("text"))).groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("dn"))
    pl = pn.groupBy("language").agg(F.sqrt(F.sum(F.col("pn") * F.col("pn"))).alias("pl"))
    dl = dn.groupBy("item_id").agg(F.sqrt(F.sum(F.col("dn") * F.col("dn"))).alias("dl"))
    dot = dn.join(pn, "g").groupBy("item_id", "language").agg(F.sum(F.col("dn") * F.col("pn")).alias("dot"))
    return dot.join(dl, "item_id").join(pl, "language").select("item_id", "language", F.round(F.col("dot") / (F.col("dl") * F.col("pl")), 6).alias("cosine"))


@query(_LEX + " SELECT language, left(word, 2) AS prefix, count(*) AS n FROM l WHERE length(word) >= 2 GROUP BY ALL")
def lex_prefixes(spark, sf):
    return _lexicon(spark, sf).where(F.length("word") >= 2).groupBy("language", F.left("word", F.lit(2)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query(_LEX + r", w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents) SELECT word FROM w WHERE word IN (SELECT word FROM l WHERE stop_word)")
def lex_stop_semi_join(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("word")).distinct()
    return words.join(_lexicon(spark, sf).where("stop_word").select("word").distinct(), "word", "left_semi")


@query(r"SELECT language, count(DISTINCT lower(e.word)) AS words, count(*) AS records FROM (SELECT language, unnest(entries) AS e FROM language_pack) GROUP BY 1")
def lex_counts(spark, sf):
    e = table(spark, sf, "language_pack").select("language", F.explode("entries").alias("e"))
    return e.groupBy("language").agg(F.countDistinct(F.lower("e.word")).alias("words"), F.count(F.lit(1)).alias("records"))


def _values(rows: list[tuple], names: str) -> str:
    """Rows of a small pack as a table of SQL."""
    quoted = lambda x: str(x) if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS p({names})"


def _readings(kind: str) -> list[tuple]:
    return [(token, text, lang) for token, own in sorted(getattr(packs.load(), kind).items()) for text, lang, _ in own]


@query(rf"""WITH t AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{{S}}\x{{1F000}}-\x{{1FAFF}}]')) AS token FROM spam_item)
    SELECT token, reading, language, count(*) AS n FROM t JOIN {_values(_readings("symbols"), "token, reading, language")} USING (token) GROUP BY ALL""")
def sym_resolve(spark, sf):
    """Signs and pictures of the messages with their readings."""
    signs = table(spark, sf, "spam_item").select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{S}\x{1F000}-\x{1FAFF}])"), 1))).alias("token")).distinct()
    readings = packs.symbol_table(spark, packs.load())
    return signs.join(readings, "token").groupBy("token", "reading", "language").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH t AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(b), '\s+')) AS token FROM evaluation_case WHERE b IS NOT NULL)
    SELECT token, reading, language, count(*) AS n FROM t JOIN {_values(_readings("abbreviations"), "token, reading, language")} USING (token) GROUP BY ALL""")
def abbr_resolve(spark, sf):
    words = table(spark, sf, "evaluation_case").where("b IS NOT NULL").select("id", F.explode(F.array_distinct(F.split(F.lower("b"), r"\s+"))).alias("token")).distinct()
    return words.join(packs.abbreviation_table(spark, packs.load()), "token").groupBy("token", "reading", "language").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query, id, round(sim, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vec_ann(spark, sf):
    """Neighbours of every twentieth vector by cells; the same as by comparing all."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.cell_search(v, v.where("id % 20 = 0"), 10, cell=200).select("query", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query(_PRED + ", b2 AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS c, avg(p) AS conf, avg((gold = predicted)::INT) AS acc FROM b GROUP BY 1) SELECT round(sum(c * abs(conf - acc)) / sum(c), 6) AS ece FROM b2")
def dec_calibration_error(spark, sf):
    binned = _predicted(spark, sf).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("conf"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("acc"))
    return binned.agg(F.round(F.sum(F.col("c") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("c"), 6).alias("ece"))


@query(_DEC + " SELECT coalesce(task, '?') AS task, count(DISTINCT id) AS n, round(avg(p), 6) AS mean_p FROM e GROUP BY 1")
def dec_by_task(spark, sf):
    from quillmesh.plans.measures import _flat

    return _flat(spark, sf).groupBy(F.coalesce("task", F.lit("?")).alias("task")).agg(F.countDistinct("id").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query("SELECT category AS gold, text AS state FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(text)) AS k FROM documents WHERE text IS NOT NULL AND category IS NOT NULL) WHERE k <= 10")
def prep_balanced_decisions(spark, sf):
    """Ten documents of each category, drawn by hash."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL AND category IS NOT NULL")
    return datasets.balanced_decisions(rows, "text", "category", 10).select("gold", "state")


@query()
def eval_rebus(spark, sf):
    """How often the wanted words are among the first readings of a text."""
    from quillmesh.functions import rebus

    rows = table(spark, sf, "evaluation_case").where("b IS NOT NULL AND size(expected.decoded_contains) > 0").select("id", "b", F.col("expected.decoded_contains").alias("wanted")).dropDuplicates(["id"])
    ranked = rows.select("id", "wanted", F.posexplode_outer(rebus.decode(F.col("b"), packs.load())).alias("rank", "r"))
    hit = F.forall("wanted", lambda w: F.contains(F.lower(F.coalesce("r.text", F.lit(""))), F.lower(w)))
    return M.ranking_metrics(ranked.select(F.col("id").alias("query"), (F.coalesce("rank", F.lit(0)) + 1).alias("rank"), F.coalesce(hit, F.lit(False)).alias("relevant")))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def rel_full_join(spark, sf):
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = table(spark, sf, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def rel_grouping_sets(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE * embedding[i + 32]::DOUBLE)), 6) AS dot FROM embeddings")
def rel_positional_join(spark, sf):
    halves = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: a.cast("double") * b.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(halves, F.lit(0.0), lambda s, x: s + x), 6).alias("dot"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def rel_approximate(spark, sf):
    """The approximate count beside the exact one, as to whether it is within a tenth of it, and the approximate median, which is
    exact for so few values."""
    approximate = F.approx_count_distinct("l_partkey", 0.02)
    exact = F.countDistinct("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(approximate - exact) <= 0.1 * exact).alias("near"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM d")
def rel_daily_change(spark, sf):
    per = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("event_type").orderBy("day")))


@query("SELECT user_id, max(ts) AS last, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id")
def rel_latest(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", "ts").alias("last_type"))
