"""Exact dense search over vector tables.

Up to ``QUERY_LIMIT`` queries (checked) are broadcast, and each partition of the
vectors scores all of them and keeps its own best k, so only k rows for each query
and partition are exchanged. More queries go in blocks of about that size: blocks
and vectors meet in cells of (block, share of the vectors), each its own task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wadi.functions import vectors as V

QUERY_LIMIT = 4096


def similarities(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score, ...) of queries (query_id, q) and vectors (vec_id, v, ...)."""
    blocks = max(1, -(-queries.count() // QUERY_LIMIT))
    one = F.collect_list(F.struct("query_id", "q")).alias("batch")  # bounded: about QUERY_LIMIT
    if blocks == 1:
        rows = vectors.join(F.broadcast(queries.agg(one)), F.lit(True))
    else:
        shares = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batch = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(one).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = vectors.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        rows = dealt.join(batch, ["block", "share"]).drop("block", "share")
    rows = rows.withColumn("one", F.explode("batch")).drop("batch")
    keep = [c for c in vectors.columns if c != "v"]
    return rows.select(F.col("one.query_id").alias("query_id"), *keep, F.round(V.dot(F.col("one.q"), F.col("v")), 6).alias("score"))


def top(found: DataFrame, k: int, *strata: str) -> DataFrame:
    """Best k of each query (and stratum), by score, then id."""
    w = Window.partitionBy("query_id", *strata).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def best_of(lists: DataFrame) -> DataFrame:
    """One row for each query and id, with its best score, ranked anew."""
    best = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long"))
