"""Ordered-row operators: passages, runs, fills, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_passages(df: DataFrame, group: str, order: str, sizes: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """(group, size, start, n, members): windows of (size, stride) over the rows of each group.

    A group of fewer rows than the size has none; a shorter last window stays
    while it has at least max(2, size // 2) rows. Each row goes to the few windows
    that hold it (size / stride of them), so a long group is never one array.
    """
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("total", F.count("*").over(Window.partitionBy(group)))
    spec = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(t).alias("stride")) for s, t in sizes]))
    rows = rows.withColumn("spec", spec).select("*", "spec.size", "spec.stride").where(F.col("total") >= F.col("size"))
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - F.col("size")) / F.col("stride")).cast("int") + 1)
    last = F.floor(F.col("rn") / F.col("stride")).cast("int")
    # a start counts if its window, cut at the group's end, is long enough
    rows = rows.withColumn("start", F.explode(F.transform(F.sequence(first, F.greatest(first, last)), lambda i: i * F.col("stride"))))
    length = F.least(F.col("size"), F.col("total") - F.col("start"))
    rows = rows.where((F.col("start") <= F.col("rn")) & (F.col("rn") < F.col("start") + F.col("size")) & (length >= F.greatest(F.lit(2), F.floor(F.col("size") / 2))))
    member = F.struct("rn", *keep)
    return rows.groupBy(group, "size", "start").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))


def run_ids(change: Column, by: list[str], order: list[str]) -> Column:
    """Running number of runs: one more wherever ``change`` is true."""
    return F.sum(F.when(change, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def changed(c: str, by: list[str], order: list[str]) -> Column:
    """Whether a value differs from that of the row before (the first row differs)."""
    before = F.lag(c).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return first | ~F.col(c).eqNullSafe(before)


def runs(df: DataFrame, by: str, order: str, value: str, block: int = 1 << 16) -> DataFrame:
    """(by, run, value, first, last, n): runs of equal values in each group, numbered from 1 in its order.

    ``order`` is a long. Rows are taken in blocks of its range, so that a group with
    a third of all rows is many tasks; only one row a block is ranked by group.
    """
    rows = df.select(by, order, value).withColumn("_block", F.floor(F.col(order) / block))
    keys = [by, "_block"]
    rows = rows.withColumn("_new", changed(value, keys, [order])).withColumn("_run", run_ids(F.col("_new"), keys, [order]))
    parts = rows.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    edges = parts.groupBy(*keys).agg(F.max("_run").alias("_runs"), F.min_by(value, "_run").alias("_head"), F.max_by(value, "_run").alias("_tail"))
    w = Window.partitionBy(by).orderBy("_block")
    starts = F.row_number().over(w) == 1
    goes_on = (~starts & F.col("_head").eqNullSafe(F.lag("_tail").over(w))).cast("int")
    edges = edges.withColumn("_joined", goes_on)
    edges = edges.select(F.col(by).alias("_by"), F.col("_block").alias("_at"), (F.sum(F.col("_runs") - F.col("_joined")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_runs")).alias("_before"))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_at"))
    at = parts.join(edges, same).select(by, (F.col("_before") + F.col("_run")).alias("run"), value, "first", "last", "n")
    return at.groupBy(by, "run", value).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def forward_fill(c: str, by: list[str], order: list[str]) -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_max(c: Column, by: list[str], order: list[str]) -> Column:
    return F.max(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(days: DataFrame, by: str, day: str) -> DataFrame:
    """(by, first, last, n): runs of consecutive distinct days."""
    base = days.select(by, day).distinct()
    key = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(by).orderBy(day)))
    return base.withColumn("island", key).groupBy(by, "island").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("island")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def gap_sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """(by, session, start, end, n): a new session after a gap over ``gap_seconds``; batch twin of ``session_window``."""
    w = Window.partitionBy(by).orderBy(ts)
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    numbered = events.withColumn("session", F.sum(F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
