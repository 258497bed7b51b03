"""Ordered events: days, streaks, sessions, runs, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wadi.operators import windows as W
from wadi.plans.tables import table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


def daily_minutes(spark, sf):
    """Minutes by user and day (values are seconds), rounded, and whether a goal of 15 is met."""
    d = _events(spark, sf).groupBy("user_id", "day").agg(F.sum("value").alias("seconds"))
    return d.select("user_id", "day", F.round(F.col("seconds") / 60, 4).alias("minutes"), (F.col("seconds") >= 15 * 60).alias("met"))


def streaks(spark, sf):
    """Runs of days in a row."""
    return W.islands(_events(spark, sf), "user_id", "day").select("user_id", "first", "last", "n")


def current_streak(spark, sf):
    """Days in a row that end on the last day of the table, or the day before if that one is empty."""
    today = _events(spark, sf).agg(F.max("day").alias("today"))  # one row
    runs = W.islands(_events(spark, sf), "user_id", "day").crossJoin(F.broadcast(today)).where((F.col("last") == F.col("today")) | (F.col("last") == F.date_sub("today", 1))).drop("today")
    users = _events(spark, sf).select("user_id").distinct()
    return users.join(runs, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("streak"))


def latest_per_group(spark, sf):
    """The latest event of each type for a user, newest first, at most 50 for each user."""
    e = _events(spark, sf)
    last = W.first_wins(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return last.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 50").select("user_id", "event_type", "event_id", "place")


def gap_sessions(spark, sf):
    """Sessions after gaps of more than six hours."""
    s = W.gap_sessions(_events(spark, sf), "user_id", "ts", 6 * 3600)
    return s.select("user_id", "session", "start", "end", "n")


def dynamic_sessions(spark, sf):
    """session_window with a gap that depends on the row: two hours after a click, else one."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.when(F.col("event_type") == "click", "2 hours").otherwise("1 hour")
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("n").agg(F.count("*").alias("sessions"))


def run_collapse(spark, sf):
    """Runs of equal event types become one row."""
    e = _events(spark, sf)
    e = e.withColumn("new", W.changed("event_type", ["user_id"], ["event_id"]))
    e = e.withColumn("run", W.run_ids(F.col("new"), ["user_id"], ["event_id"]))
    return e.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "first", "n")


def forward_fill(spark, sf):
    """The last purchase value so far and the running maximum, at each event."""
    e = _events(spark, sf).withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", W.forward_fill("paid", ["user_id"], ["event_id"]).alias("last_paid"), W.running_max(F.col("value"), ["user_id"], ["event_id"]).alias("top"))


def fractional_position(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round((F.row_number().over(w) - 1) / n, 6).alias("position"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("chars_so_far"))


def upsert_latest(spark, sf):
    """Current state of (user, type): the last write wins."""
    e = _events(spark, sf)
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"), F.count("*").alias("writes"))


def first_missing(spark, sf):
    """The least order line number from 1 on that an order lacks."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    top = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top"))
    all_ = top.select("l_orderkey", F.explode(F.sequence(F.lit(1), F.col("top") + 1)).alias("l_linenumber"))
    return all_.join(li, ["l_orderkey", "l_linenumber"], "left_anti").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("missing"))


def successor(spark, sf):
    """The next order of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next_order"))


def toggled_state(spark, sf):
    """Bookmarks from an event log: signup sets, error removes, clear (purchase) empties; what stands at the end."""
    e = _events(spark, sf).where(F.col("event_type").isin("signup", "error", "purchase"))
    item = F.floor(F.col("value")).cast("long") % 5
    e = e.select("user_id", "event_id", "event_type", item.alias("item"))
    cleared = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("cleared"))
    last = e.where("event_type <> 'purchase'").groupBy("user_id", "item").agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("event_id"))
    return last.join(cleared, "user_id", "left").where((F.col("kind") == "signup") & (F.col("event_id") > F.coalesce("cleared", F.lit(-1)))).select("user_id", "item")


def progress_ratio(spark, sf):
    """Share of a customer's order value that is done, rounded percent."""
    o = table(spark, sf, "orders")
    done = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0))
    return o.groupBy("o_custkey").agg(F.least(F.lit(100), F.round(100 * done / F.sum("o_totalprice"), 0).cast("int")).cast("long").alias("percent"))


NAMES = "daily_minutes streaks current_streak latest_per_group gap_sessions dynamic_sessions run_collapse forward_fill fractional_position upsert_latest first_missing successor toggled_state progress_ratio"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_E = "(SELECT *, CAST(ts AS DATE) AS day FROM events)"
_ISLANDS = f"(SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT user_id, day FROM {_E})) GROUP BY user_id, g)"
SQL = {
    "daily_minutes": f"SELECT user_id, day, round(sum(value) / 60, 4) AS minutes, sum(value) >= 900 AS met FROM {_E} GROUP BY user_id, day",
    "streaks": f"SELECT * FROM {_ISLANDS}",
    "current_streak": f"SELECT u.user_id, coalesce(i.n, 0) AS streak FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {_ISLANDS} i ON i.user_id = u.user_id AND i.last >= (SELECT max(CAST(ts AS DATE)) FROM events) - 1",
    "latest_per_group": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
      SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM l QUALIFY place <= 50""",
    "gap_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""",
    "dynamic_sessions": """WITH e AS (SELECT user_id, ts, ts + CASE WHEN event_type = 'click' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS until FROM events),
      g AS (SELECT *, CASE WHEN ts < max(until) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT n, count(*) AS sessions FROM c GROUP BY n""",
    "run_collapse": """WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events),
      r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c) SELECT user_id, run, event_type, min(event_id) AS first, count(*) AS n FROM r GROUP BY ALL""",
    "forward_fill": """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_paid, max(value) OVER w AS top FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "fractional_position": """SELECT conv_id, turn, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS position, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "upsert_latest": "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id, count(*) AS writes FROM events GROUP BY ALL",
    "first_missing": """WITH t AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 2)) AS k FROM lineitem GROUP BY l_orderkey)
      SELECT t.l_orderkey, min(k) AS missing FROM t LEFT JOIN lineitem l ON l.l_orderkey = t.l_orderkey AND l.l_linenumber = k WHERE l.l_orderkey IS NULL GROUP BY t.l_orderkey""",
    "successor": "SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders",
    "toggled_state": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) % 5 AS item FROM events), c AS (SELECT user_id, max(event_id) AS cleared FROM e WHERE event_type = 'purchase' GROUP BY user_id),
      l AS (SELECT user_id, item, max_by(event_type, event_id) AS kind, max(event_id) AS event_id FROM e WHERE event_type IN ('signup', 'error') GROUP BY ALL)
      SELECT l.user_id, item FROM l LEFT JOIN c USING (user_id) WHERE kind = 'signup' AND event_id > coalesce(cleared, -1)""",
    "progress_ratio": "SELECT o_custkey, CAST(least(100, round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 0)) AS BIGINT) AS percent FROM orders GROUP BY o_custkey",
}
