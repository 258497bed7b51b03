"""Metrics, weighted aggregates and grouping sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wadi.operators import cells
from wadi.plans.retrieval import _vector_queries, _vectors
from wadi.plans.tables import table
from wadi.sources import records


def precision_recall_mrr(spark, sf):
    """Of the ten nearest others, those with the query's label count as relevant."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    hits = cells.nearest(_vector_queries(spark, sf), _vectors(spark, sf), 10, "label", others=True).join(own, "query_id").withColumn("rel", (F.col("own") == F.col("label")).cast("int"))
    total = table(spark, sf, "embeddings").groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("total"))
    q = hits.groupBy("query_id", "own").agg(F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    q = q.join(total, "own")
    return q.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("found") / 10), 6).alias("p_at_10"), F.round(F.avg(F.col("found") / F.least("total", F.lit(10))), 6).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def attribute_accuracy(spark, sf):
    """Agreement of neighbouring order lines by attribute; a null on a side is a miss; macro mean beside."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    names = ["l_returnflag", "l_linestatus", "l_suppkey"]
    li = table(spark, sf, "lineitem")
    pairs = li.select("l_orderkey", "l_linenumber", *[F.col(c).cast("string").alias(c) for c in names], *[F.lead(F.col(c).cast("string")).over(w).alias(f"{c}_next") for c in names])
    pairs = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("a"), F.col(f"{c}_next").alias("b")) for c in names])).alias("x")).select("x.*")
    by = pairs.groupBy("attr").agg(F.round(F.avg(F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0))), 6).alias("accuracy"), F.count("*").alias("n"))
    return by.select("attr", "accuracy", "n", F.round(F.avg("accuracy").over(Window.partitionBy(F.lit(1))), 6).alias("macro"))  # three rows


def head_accuracy(spark, sf):
    """The same with pairs that lack a side left out, and 1 where none is left."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    both = F.col("event_type").isNotNull() & F.col("next").isNotNull()
    return e.groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(both, (F.col("event_type") == F.col("next")).cast("int"))), F.lit(1.0)), 6).alias("accuracy"), F.sum(both.cast("int")).cast("long").alias("n"))


def weighted_error_rate(spark, sf):
    """Sum of edits over sum of sizes, sizes at least 1."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.sum("l_linenumber") / F.sum(F.greatest("l_quantity", F.lit(1.0))), 6).alias("rate"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"))


def ensemble_score(spark, sf):
    li = table(spark, sf, "lineitem")
    w = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.15)
    return li.withColumn("s", (1 - w) * F.col("l_discount") + w * F.col("l_tax")).groupBy("l_suppkey").agg(F.round(F.avg("s"), 6).alias("score"), F.round(F.max("s"), 6).alias("best"))


def page_accuracy(spark, sf):
    """Mean of 1 - rate within [0, 1], and its grade."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg(1 - F.least(F.greatest(F.col("l_discount") * 8, F.lit(0.0)), F.lit(1.0))).alias("acc"))
    grade = F.when(F.col("acc") >= 0.85, "good").when(F.col("acc") >= 0.6, "fair").otherwise("weak")
    return o.withColumn("acc", F.round("acc", 6)).withColumn("grade", grade).groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg("acc"), 5).alias("mean"))


def smoke_report(spark, sf):
    """Mean value in all and by type, counts, and how many are slow."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.sum((F.col("value") > 90).cast("int")).cast("long").alias("slow"))


def majority_class(spark, sf):
    """The most frequent type of each user but clicks; of equals the one seen first; mean value of the winner."""
    e = table(spark, sf, "events").where("event_type <> 'click'")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.avg("value").alias("mean"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "first")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "n", F.round("mean", 4).alias("mean"))


def max_pool_argmax(spark, sf):
    """Position of the largest mean-pooled and max-pooled component by label, component 0 left out."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).where("pos > 0")
    p = e.groupBy("label", "pos").agg(F.max(F.col("x").cast("double")).alias("top"))
    w = Window.partitionBy("label").orderBy(F.desc("top"), "pos")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", F.col("pos").cast("long").alias("pos"), F.round("top", 6).alias("top"))


def rollup_counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def record_round_trip(spark, sf):
    """Each order's lines as a JSON document, read back."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag")
    keys = ["l_orderkey"]
    back = records.read_records(records.write_records(li, keys, "l_linenumber"), records.record_schema(li, keys, "l_linenumber"))
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.sum(F.col("l_partkey").cast("long") * F.col("l_linenumber")).alias("parts"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def approx_distinct(spark, sf):
    """Approximate counts (rows only: sketches differ between engines)."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts"))


def asof_latest(spark, sf):
    """For each purchase the user's last view before it or at the same time.

    One pass over the user's rows in time order: purchases read the last view
    so far, so nothing is joined pair by pair.
    """
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_type", F.get_json_object("props", "$.k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def set_operations(spark, sf):
    """Intersect and except with multiplicities, over users of two event types."""
    e = table(spark, sf, "events")
    a, b = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id")
    part = lambda df, n: df.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "user_id", "n")
    return part(a.intersectAll(b), "both").unionByName(part(a.exceptAll(b), "more")).unionByName(part(a.union(b).distinct(), "any"))


def daily_pricing(spark, sf):
    """Pricing summary by flag and status."""
    li = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


NAMES = "precision_recall_mrr attribute_accuracy head_accuracy weighted_error_rate ensemble_score page_accuracy smoke_report majority_class max_pool_argmax rollup_counts cube_counts record_round_trip approx_distinct asof_latest json_props set_operations daily_pricing"
QUERIES = {n: globals()[n] for n in NAMES.split()}

SQL = {
    "record_round_trip": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, CAST(sum(CAST(l_partkey AS BIGINT) * l_linenumber) AS BIGINT) AS parts, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS quantity FROM lineitem GROUP BY 1",
    "precision_recall_mrr": """WITH q AS (SELECT vec_id AS query_id, label AS own, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
      h AS (SELECT query_id, own, CASE WHEN own = label THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS rank FROM q, embeddings WHERE query_id <> vec_id QUALIFY rank <= 10),
      t AS (SELECT label AS own, count(*) - 1 AS total FROM embeddings GROUP BY label), s AS (SELECT query_id, own, sum(rel) AS found, min(CASE WHEN rel = 1 THEN rank END) AS first FROM h GROUP BY query_id, own)
      SELECT count(*) AS queries, round(avg(found / 10), 6) AS p_at_10, round(avg(found / least(total, 10)), 6) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM s JOIN t USING (own)""",
    "attribute_accuracy": """WITH p AS (SELECT l_returnflag AS a1, lead(l_returnflag) OVER w AS b1, l_linestatus AS a2, lead(l_linestatus) OVER w AS b2, l_suppkey AS a3, lead(l_suppkey) OVER w AS b3 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
      u AS (SELECT 'l_returnflag' AS attr, coalesce(CAST(a1 = b1 AS INTEGER), 0) AS m FROM p UNION ALL SELECT 'l_linestatus', coalesce(CAST(a2 = b2 AS INTEGER), 0) FROM p UNION ALL SELECT 'l_suppkey', coalesce(CAST(a3 = b3 AS INTEGER), 0) FROM p),
      g AS (SELECT attr, round(avg(m), 6) AS accuracy, count(*) AS n FROM u GROUP BY attr) SELECT *, round(avg(accuracy) OVER (), 6) AS macro FROM g""",
    "head_accuracy": """WITH e AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
      SELECT user_id, round(coalesce(avg(CASE WHEN b IS NOT NULL THEN CAST(a = b AS INTEGER) END), 1.0), 6) AS accuracy, count(b) AS n FROM e GROUP BY user_id""",
    "weighted_error_rate": "SELECT l_returnflag, round(sum(l_linenumber) / sum(greatest(l_quantity, 1)), 6) AS rate, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY l_returnflag",
    "ensemble_score": "WITH s AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 0.5e0 * l_discount + 0.5e0 * l_tax ELSE 0.85e0 * l_discount + 0.15e0 * l_tax END AS s FROM lineitem) SELECT l_suppkey, round(avg(s), 6) AS score, round(max(s), 6) AS best FROM s GROUP BY l_suppkey",
    "page_accuracy": """WITH o AS (SELECT l_orderkey, avg(1 - least(greatest(l_discount * 8, 0.0), 1.0)) AS a FROM lineitem GROUP BY l_orderkey), r AS (SELECT round(a, 6) AS acc FROM o)
      SELECT CASE WHEN acc >= 0.85 THEN 'good' WHEN acc >= 0.6 THEN 'fair' ELSE 'weak' END AS grade, count(*) AS n, round(avg(acc), 5) AS mean FROM r GROUP BY grade""",
    "smoke_report": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count(*) FILTER (WHERE value > 90) AS slow FROM events GROUP BY event_type",
    "majority_class": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, avg(value) AS mean FROM events WHERE event_type <> 'click' GROUP BY ALL)
      SELECT user_id, event_type, n, round(mean, 4) AS mean FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""",
    "max_pool_argmax": """WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), p AS (SELECT label, pos, max(x) AS top FROM e WHERE pos > 0 GROUP BY ALL)
      SELECT label, pos, round(top, 6) AS top FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY top DESC, pos) = 1""",
    "rollup_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "asof_latest": """SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id FROM events p WHERE p.event_type = 'purchase'""",
    "json_props": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
    "set_operations": """WITH a AS (SELECT user_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id FROM events WHERE event_type = 'purchase')
      SELECT 'both' AS kind, user_id, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY user_id UNION ALL
      SELECT 'more', user_id, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY user_id UNION ALL SELECT 'any', user_id, count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY user_id""",
    "daily_pricing": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
}
