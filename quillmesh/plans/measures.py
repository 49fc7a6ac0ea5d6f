"""Queries over decisions and evaluation: distributions, calibration, metrics, gates, splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.operators import measures as M
from quillmesh.operators import scoring
from quillmesh.plans.registry import Registry
from quillmesh.runtime import table

query = Registry()

_DEC = """WITH d AS (SELECT DISTINCT id, task, gold, map_keys(teacher_probabilities) AS ks, map_values(teacher_probabilities) AS ps FROM decision_example WHERE teacher_probabilities IS NOT NULL),
    e AS (SELECT id, task, gold, unnest(ks) AS label, unnest(ps) AS p FROM d)"""


def _dec(spark, sf):
    return table(spark, sf, "decision_example").where("teacher_probabilities IS NOT NULL").select("id", "task", "gold", F.map_entries("teacher_probabilities").alias("m")).distinct()


def _flat(spark, sf):
    return _dec(spark, sf).select("id", "task", "gold", F.explode("m").alias("e")).select("id", "task", "gold", F.col("e.key").alias("label"), F.col("e.value").alias("p"))


@query(_DEC + " SELECT id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, round(max(p), 6) AS top, round(sum(p), 6) AS total FROM e GROUP BY id")
def dec_entropy(spark, sf):
    p = F.transform("m", lambda e: e["value"])
    return _dec(spark, sf).select("id", F.round(M.entropy(p), 6).alias("entropy"), F.round(F.array_max(p), 6).alias("top"), F.round(F.aggregate(p, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(_DEC + ", r AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS k FROM e) SELECT id, round(max(p) FILTER (k = 1) - coalesce(max(p) FILTER (k = 2), 0), 6) AS margin FROM r GROUP BY id")
def dec_margin(spark, sf):
    return _dec(spark, sf).select("id", F.round(M.margin(F.transform("m", lambda e: e["value"])), 6).alias("margin"))


@query(_DEC + " SELECT id, round(-ln(greatest(max(p) FILTER (label = gold), 1e-12)), 6) AS nll, round(sum((p - CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) ** 2) / count(*), 6) AS brier FROM e WHERE gold IS NOT NULL GROUP BY id HAVING bool_or(label = gold)")
def dec_losses(spark, sf):
    p, names = F.transform("m", lambda e: e["value"]), F.transform("m", lambda e: e["key"])
    rows = _dec(spark, sf).where("gold IS NOT NULL").withColumn("g", F.array_position(names, F.col("gold")) - 1).where("g >= 0")
    return rows.select("id", F.round(M.nll(F.get(p, F.col("g").cast("int"))), 6).alias("nll"), F.round(M.brier(p, F.col("g")), 6).alias("brier"))


@query(_DEC + ", x AS (SELECT id, label, ln(greatest(p, 1e-12)) / 2.0 AS z FROM e) SELECT id, label, round(exp(z) / sum(exp(z)) OVER (PARTITION BY id), 6) AS p FROM x")
def dec_softmax_temperature(spark, sf):
    """Distributions softened by a temperature of two."""
    x = F.transform("m", lambda e: F.ln(F.greatest(e["value"], F.lit(1e-12))))
    soft = F.arrays_zip(F.transform("m", lambda e: e["key"]).alias("label"), M.softmax(x, 2.0).alias("p"))
    return _dec(spark, sf).select("id", F.explode(soft).alias("z")).select("id", F.col("z.label").alias("label"), F.round("z.p", 6).alias("p"))


@query(_DEC + " SELECT id, round(-ln(sum(exp(ln(greatest(p, 1e-12))))), 6) AS energy FROM e GROUP BY id")
def dec_energy(spark, sf):
    x = F.transform("m", lambda e: F.ln(F.greatest(e["value"], F.lit(1e-12))))
    return _dec(spark, sf).select("id", F.round(M.energy(x), 6).alias("energy"))


@query(_DEC + ", r AS (SELECT id, label, p, row_number() OVER (PARTITION BY id ORDER BY label) - 1 AS i FROM e) SELECT id, round(sum(i * p), 6) AS expected FROM r GROUP BY id")
def dec_expected_score(spark, sf):
    ordered = F.transform(F.array_sort("m"), lambda e: e["value"])
    return _dec(spark, sf).select("id", F.round(M.expected(ordered), 6).alias("expected"))


_PRED = _DEC + ", b AS (SELECT id, task, gold, label AS predicted, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS k FROM e) WHERE k = 1 AND gold IS NOT NULL)"


def _predicted(spark, sf):
    best = F.element_at(F.array_sort(F.transform("m", lambda e: F.struct((-e["value"]).alias("q"), e["key"].alias("label")))), 1)
    return _dec(spark, sf).where("gold IS NOT NULL").select("id", "task", "gold", best.alias("b")).select("id", "task", "gold", F.col("b.label").alias("predicted"), (-F.col("b.q")).alias("p"))


@query(_PRED + " SELECT coalesce(task, '?') AS task, gold, predicted, count(*) AS n FROM b GROUP BY ALL")
def dec_confusion(spark, sf):
    return _predicted(spark, sf).groupBy(F.coalesce("task", F.lit("?")).alias("task"), "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(_PRED + " SELECT gold, count(*) FILTER (predicted = 'true') AS said_true, count(*) FILTER (predicted = 'false') AS said_false FROM b WHERE gold IN ('true', 'false') GROUP BY gold")
def dec_confusion_pivot(spark, sf):
    rows = _predicted(spark, sf).where(F.col("gold").isin("true", "false"))
    wide = rows.groupBy("gold").pivot("predicted", ["true", "false"]).count()
    return wide.select("gold", F.coalesce("true", F.lit(0)).alias("said_true"), F.coalesce("false", F.lit(0)).alias("said_false"))


@query(_PRED + """, l AS (SELECT gold AS label FROM b UNION SELECT predicted FROM b), c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS pp, count(*) FILTER (gold = label) AS ap FROM l, b GROUP BY label)
    SELECT label, tp, pp, ap, round(CASE WHEN pp + ap > 0 THEN 2.0 * tp / (pp + ap) ELSE 0 END, 6) AS f1 FROM c""")
def dec_class_f1(spark, sf):
    b = _predicted(spark, sf)
    said = b.select(F.col("predicted").alias("label"), F.lit(1).alias("pp"), F.lit(0).alias("ap"), (F.col("gold") == F.col("predicted")).cast("int").alias("tp"))
    true = b.select(F.col("gold").alias("label"), F.lit(0).alias("pp"), F.lit(1).alias("ap"), F.lit(0).alias("tp"))
    return said.unionByName(true).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap")).withColumn("f1", F.round(F.when(F.col("pp") + F.col("ap") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("ap"))).otherwise(0.0), 6))


@query(_PRED + ", t AS (SELECT count(*) AS n FROM b), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS k FROM b), c AS (SELECT unnest([1.0, 0.95, 0.9, 0.8, 0.7, 0.5]) AS coverage) SELECT coverage::DOUBLE AS coverage, count(*) AS kept, round(1 - avg((gold = predicted)::INT), 6) AS risk FROM c, t JOIN r ON r.k <= ceil(coverage * t.n) GROUP BY coverage")
def dec_risk_coverage(spark, sf):
    """Error among the surest parts of the decisions."""
    from quillmesh.runtime import cut

    b = cut(_predicted(spark, sf))
    n = b.count()
    # a place by descending probability: counts of coarser probability bins come first, then places inside a bin
    b = b.withColumn("bin", F.floor(F.col("p") * 4096))
    ahead = b.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = b.withColumn("i", F.row_number().over(W.partitionBy("bin").orderBy(F.desc("p"), "id"))).join(ahead, "bin").withColumn("k", F.col("before") + F.col("i"))
    levels = F.filter(F.array(*(F.lit(x) for x in (1.0, 0.95, 0.9, 0.8, 0.7, 0.5))), lambda c: F.col("k") <= F.ceil(c * n))
    return placed.select(F.explode(levels).alias("coverage"), (F.col("gold") == F.col("predicted")).cast("double").alias("hit")).groupBy("coverage").agg(F.count(F.lit(1)).alias("kept"), F.round(1 - F.avg("hit"), 6).alias("risk"))


@query(_PRED + " SELECT id, predicted, CASE WHEN p >= 0.7 THEN 'accept' ELSE 'escalate' END AS decision FROM b")
def dec_selective(spark, sf):
    return _predicted(spark, sf).select("id", "predicted", F.when(F.col("p") >= 0.7, "accept").otherwise("escalate").alias("decision"))


@query(_DEC + """, g AS (SELECT i, 0.05 * 100 ** (i / 59.0) AS t FROM range(60) r(i)), x AS (SELECT i, t, id, label, gold, ln(greatest(p, 1e-12)) / t AS z FROM e, g WHERE gold IS NOT NULL),
    s AS (SELECT i, t, id, max(z) FILTER (label = gold) AS zg, max(z) AS top, sum(exp(z - (SELECT 0))) AS raw FROM x GROUP BY ALL HAVING bool_or(label = gold)),
    n AS (SELECT s.i, s.t, -ln(greatest(exp(s.zg - s.top) / (SELECT sum(exp(x.z - s.top)) FROM x WHERE x.i = s.i AND x.id = s.id), 1e-12)) AS nll FROM s)
    SELECT round(t, 6) AS temperature, round(avg(nll), 4) AS nll FROM n GROUP BY t""")
def dec_temperature_grid(spark, sf):
    """Mean loss of the decisions at each of sixty temperatures."""
    x = F.transform("m", lambda e: F.ln(F.greatest(e["value"], F.lit(1e-12))))
    g = F.array_position(F.transform("m", lambda e: e["key"]), F.col("gold")).cast("int") - 1
    rows = _dec(spark, sf).where("gold IS NOT NULL").select("id", x.alias("x"), g.alias("g")).where("g >= 0")
    grid = F.explode(F.array(*(F.lit(t) for t in M.temperature_grid())))
    wide = rows.select("x", "g", grid.alias("t"))
    top = F.array_max("x")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.exp((v - top) / F.col("t")))
    p = F.exp((F.get("x", F.col("g")) - top) / F.col("t")) / total
    return wide.select("t", M.nll(p).alias("nll")).groupBy(F.round("t", 6).alias("temperature")).agg(F.round(F.avg("nll"), 4).alias("nll"))


@query("""SELECT DISTINCT id, question.type AS kind, len(map_keys(question.criteria)) AS choices, CASE question.type WHEN 'choice' THEN question.criteria IS NOT NULL WHEN 'binary' THEN question.statement IS NOT NULL ELSE question.levels IS NOT NULL END AS complete FROM decision_example""")
def dec_types(spark, sf):
    """Whether each question has the members that its type needs."""
    q = F.col("question")
    ok = F.when(q["type"] == "choice", q["criteria"].isNotNull()).when(q["type"] == "binary", q["statement"].isNotNull()).otherwise(q["levels"].isNotNull())
    return table(spark, sf, "decision_example").select("id", q["type"].alias("kind"), F.when(q["criteria"].isNotNull(), F.size(F.map_keys(q["criteria"]))).alias("choices"), ok.alias("complete")).distinct()


@query("SELECT DISTINCT id, label, 'State: ' || state || chr(10) || 'Answer: ' || label AS prompt FROM (SELECT id, state, unnest(map_keys(question.criteria)) AS label FROM decision_example WHERE state IS NOT NULL)")
def dec_prompts(spark, sf):
    """The prompt of each candidate answer."""
    rows = table(spark, sf, "decision_example").where("state IS NOT NULL").select("id", "state", F.explode(F.map_keys("question.criteria")).alias("label"))
    return rows.select("id", "label", F.concat(F.lit("State: "), "state", F.lit("\nAnswer: "), "label").alias("prompt")).distinct()


# ------------------------------------------------------------------------------------------------ evaluation

_SPAM = r"""WITH d AS (SELECT id, max(text) AS text, max(lower(label)) AS label FROM spam_item WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY id),
    s AS (SELECT id, CASE WHEN label = 'spam' THEN 1.0 ELSE 0.0 END AS y, least(1.0, 0.2 + 0.4 * len(regexp_extract_all(text, '!'))) AS s FROM d)"""


def _spam(spark, sf):
    """Labels and a plain score of the messages: exclamation marks."""
    d = table(spark, sf, "spam_item").where("text IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"), F.max(F.lower("label")).alias("label"))
    return d.select("id", (F.col("label") == "spam").cast("double").alias("label"), F.least(F.lit(1.0), 0.2 + 0.4 * F.regexp_count("text", F.lit("!"))).alias("score"))


@query(_SPAM + """, a AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s), b AS (SELECT least(floor(s * 10), 9) AS bin, count(*) AS c, abs(avg(s) - avg(y)) AS gap FROM s GROUP BY 1),
    m AS (SELECT count(*) AS n, sum(y) AS pos, avg(((s >= 0.5) = (y = 1))::INT) AS accuracy, sum((s >= 0.5)::INT * y) AS tp, sum((s >= 0.5)::INT) AS pp, avg((s - y) ** 2) AS brier, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs FROM a)
    SELECT n, round(accuracy, 6) AS accuracy, round(tp / pp, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (pp + pos), 6) AS f1, round((rs - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc, round(brier, 6) AS brier, round((SELECT sum(c * gap) / sum(c) FROM b), 6) AS ece FROM m""")
def eval_binary(spark, sf):
    return M.binary_metrics(_spam(spark, sf))


@query(_SPAM + ", v AS (SELECT s, count(*) AS c, sum(y) AS p FROM s GROUP BY 1), k AS (SELECT *, sum(c) OVER (ORDER BY s DESC) AS n, sum(p) OVER (ORDER BY s DESC) AS tp FROM v) SELECT round(s, 6) AS threshold, n, tp, round(tp / n, 6) AS precision, round(tp / (SELECT sum(p) FROM v), 6) AS recall FROM k")
def eval_pr_curve(spark, sf):
    """Precision and recall at each distinct score; there are few, as it counts signs."""
    v = _spam(spark, sf).groupBy("score").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("p"))
    w = W.orderBy(F.desc("score"))
    k = v.withColumn("n", F.sum("c").over(w)).withColumn("tp", F.sum("p").over(w)).crossJoin(v.agg(F.sum("p").alias("all")))
    return k.select(F.round("score", 6).alias("threshold"), "n", "tp", F.round(F.col("tp") / F.col("n"), 6).alias("precision"), F.round(F.col("tp") / F.col("all"), 6).alias("recall"))


_VEC = "WITH q AS (SELECT vec_id AS query, embedding AS q, label AS ql FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, ql = label AS relevant, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> query)"


@query(_VEC + ", f AS (SELECT query, min(rank) FILTER (relevant) AS first FROM s GROUP BY query) SELECT count(*) AS queries, round(avg((coalesce(first, 1000000) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 1000000) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(first, 1000000) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END), 6) AS ndcg_10 FROM f")
def eval_ranking(spark, sf):
    from quillmesh.operators.retrieval import exact_search

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = exact_search(v.select("id", "vector"), v.where("id % 20 = 0").select("id", "vector"), 50)
    own = v.select(F.col("id").alias("query"), F.col("label").alias("ql"))
    return M.ranking_metrics(found.join(own, "query").join(v.select("id", "label"), "id").withColumn("relevant", F.col("ql") == F.col("label")))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def eval_latency(spark, sf):
    """Mean and nearest-rank percentiles of the events' values."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("""WITH c AS (SELECT DISTINCT id, CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'valid', 'dev') THEN 'validation' ELSE 'test' END AS split FROM evaluation_case) SELECT split, count(*) AS n FROM c GROUP BY 1""")
def src_split_counts(spark, sf):
    s = F.lower(F.trim("split"))
    split = F.when(s.isin("train", "training"), "train").when(s.isin("validation", "valid", "dev"), "validation").otherwise("test")
    return table(spark, sf, "evaluation_case").select("id", split.alias("split")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT id, max(nullif(category, '')) AS category, max(labels['similar']::INT) AS alike FROM evaluation_case GROUP BY id) SELECT coalesce(category, 'general') AS category, count(*) AS n, sum(alike) AS n_similar FROM c GROUP BY ROLLUP (coalesce(category, 'general'))""")
def eval_category(spark, sf):
    """Cases by category, and in all."""
    c = table(spark, sf, "evaluation_case").groupBy("id").agg(F.max(F.nullif(F.col("category"), F.lit(""))).alias("category"), F.max(F.col("labels")["similar"].cast("int")).alias("similar"))
    return c.withColumn("category", F.coalesce("category", F.lit("general"))).rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum("similar").alias("n_similar"))


@query("""WITH c AS (SELECT DISTINCT id, unnest(expected.decoded_contains) AS wanted, lower(b) AS b FROM evaluation_case WHERE b IS NOT NULL) SELECT id, wanted, contains(b, lower(wanted)) AS met FROM c""")
def eval_decoded_contains(spark, sf):
    c = table(spark, sf, "evaluation_case").where("b IS NOT NULL").select("id", F.explode("expected.decoded_contains").alias("wanted"), F.lower("b").alias("b")).distinct()
    return c.select("id", "wanted", F.col("b").contains(F.lower("wanted")).alias("met"))


@query(_PRED + ", m AS (SELECT 'all' AS section, 'accuracy' AS metric, avg((gold = predicted)::INT) AS measured FROM b), g AS (SELECT * FROM (VALUES ('all', 'accuracy', 'min', 0.5), ('all', 'brier', 'max', 0.2)) v(section, metric, bound, value)) SELECT section, metric, bound, coalesce(CASE WHEN bound = 'min' THEN measured >= value ELSE measured <= value END, false) AS passed FROM g LEFT JOIN m USING (section, metric)")
def eval_gates(spark, sf):
    """Bounds on metrics; one that was not measured is not passed."""
    measured = _predicted(spark, sf).agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("measured")).select(F.lit("all").alias("section"), F.lit("accuracy").alias("metric"), "measured")
    bounds = spark.createDataFrame([("all", "accuracy", "min", 0.5), ("all", "brier", "max", 0.2)], "section string, metric string, bound string, value double")
    return M.gates(measured, bounds).select("section", "metric", "bound", "passed")


@query()
def fit_spam_logistic(spark, sf):
    """Weights of a spam scorer fitted to the labelled messages."""
    d = table(spark, sf, "spam_item").where("text IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"), F.max(F.lower("label")).alias("label"))
    rows = scoring.spam_features(d.withColumn("y", (F.col("label") == "spam").cast("double")))
    names = ["number_ratio", "uppercase_ratio", "punctuation_ratio", "entropy", "obfuscation_score"]
    weights, bias = M.fit_logistic(rows, names, "y", steps=10)
    return spark.createDataFrame([*zip(names, weights, strict=True), ("bias", bias)], "name string, weight double")


@query("SELECT label, count(*) AS n, round(sum(0.5 / c), 6) AS weight FROM (SELECT label, count(*) OVER (PARTITION BY label) AS c FROM embeddings) GROUP BY label")
def fit_balanced_weights(spark, sf):
    return M.balanced_weights(table(spark, sf, "embeddings"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL) SELECT label, i - 1 AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS v FROM c")
def dec_prototypes(spark, sf):
    """The mean direction of each class."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return e.select("label", "dim", F.round(F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("label"))), 5).alias("v"))
