"""Queries that cover the relational operators: joins, aggregates, windows, set operations, and windows over events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.plans.registry import Registry
from quillmesh.runtime import table
from quillmesh.streaming import jobs

query = Registry()


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def rel_pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp'2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def rel_outer_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))  # before the join, so the join moves one row a customer
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def rel_inner_joins(spark, sf):
    per = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return per.join(n, per["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name", "customers", F.round("balance", 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_semi_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def rel_anti_join(spark, sf):
    """Customers without an urgent order that is done."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rel_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def rel_pivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in ("F", "O", "P")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def rel_top_k(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders")
def rel_running_window(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("last"))


@query("SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def rel_sliding_window(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("moving"))


@query("SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier UNION SELECT c_custkey, c_nationkey FROM customer")
def rel_union(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def rel_except(spark, sf):
    return table(spark, sf, "part").select("p_partkey").exceptAll(table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("""SELECT e.event_id, max(p.event_id) AS error_id FROM events e LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.ts > e.ts - INTERVAL 1 HOUR WHERE e.event_type <> 'error' GROUP BY 1""")
def rel_range_join(spark, sf):
    """The last error id of the same user in the hour before each event, by equal hour buckets instead of a pure range."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("h"))
    errors = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"), F.explode(F.array(F.col("h"), F.col("h") + F.expr("INTERVAL 1 HOUR"))).alias("k"))
    rest = e.where("event_type <> 'error'")
    near = rest.join(errors, (rest["user_id"] == errors["u"]) & (rest["h"] == errors["k"]) & (errors["t"] <= rest["ts"]) & (errors["t"] > rest["ts"] - F.expr("INTERVAL 1 HOUR"))).groupBy("event_id").agg(F.max("error_id").alias("error_id"))
    return rest.select("event_id").join(near, "event_id", "left")


@query("SELECT o.o_orderkey, l.l_shipdate AS shipped FROM orders o ASOF JOIN (SELECT l_orderkey, l_shipdate FROM lineitem GROUP BY ALL) l ON o.o_orderkey = l.l_orderkey AND o.o_orderdate >= l.l_shipdate")
def rel_asof_join(spark, sf):
    """The last shipment of each order not after its date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")  # noqa: E741
    return o.join(l, (o["o_orderkey"] == l["l_orderkey"]) & (o["o_orderdate"] >= l["l_shipdate"])).groupBy("o_orderkey").agg(F.max("l_shipdate").alias("shipped"))


@query("SELECT event_type, count(*) AS n, round(sum((props::JSON ->> 'k')::DOUBLE), 4) AS k_sum FROM events GROUP BY 1")
def rel_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(k), 4).alias("k_sum"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def rel_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS a, round(sqrt(abs(c_acctbal)), 6) AS b, round(log2(1 + abs(c_acctbal)), 6) AS c, round(tanh(c_acctbal / 10000), 6) AS d FROM customer")
def rel_math(spark, sf):
    v = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.round(F.log1p(F.abs(v)), 6).alias("a"), F.round(F.sqrt(F.abs(v)), 6).alias("b"), F.round(F.log2(1 + F.abs(v)), 6).alias("c"), F.round(F.tanh(v / 10000), 6).alias("d"))


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer")
def rel_share_of_total(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(W.partitionBy("c_nationkey")), 8).alias("share"))


@query("SELECT c_nationkey, max_by(c_name, c_acctbal) AS richest, min_by(c_name, c_acctbal) AS poorest FROM customer GROUP BY 1")
def rel_argmax(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", "c_acctbal").alias("richest"), F.min_by("c_name", "c_acctbal").alias("poorest"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return jobs.tumbling(table(spark, sf, "events"))


@query("WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h FROM events), w AS (SELECT h AS start FROM b UNION ALL SELECT h - INTERVAL 1 HOUR FROM b) SELECT start, count(*) AS n FROM w GROUP BY 1")
def stream_sliding(spark, sf):
    return jobs.sliding(table(spark, sf, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return jobs.sessions(table(spark, sf, "events"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{Lu}')) AS upper FROM documents WHERE text IS NOT NULL")
def stream_analysis(spark, sf):
    """The stateless analysis, as a table."""
    return jobs.analysed(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"))
