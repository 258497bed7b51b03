"""Fusion, floors, caps and fills over ranked candidate lists.

All work within one query's candidates, which the retrieval budgets bound
(a few hundred rows), so windows by query are small; they are spread over as
many partitions as there are queries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, w_dense: float, w_sparse: float, k: int = RRF_K) -> DataFrame:
    """Full join of two ranked lists (query_id, doc_id, rank): both ranks, null where absent, and the weighted sum of 1 / (k + rank)."""
    a = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", "doc_id"], "full").withColumn("rrf_score", F.round(part(w_dense, "dense_rank") + part(w_sparse, "bm25_rank"), 9))


def ordered(score: str = "rrf_score", id_col: str = "doc_id") -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc(score), id_col)


def whole() -> Window:
    return Window.partitionBy("query_id")


def tail_label(score: Column, ratio: float = 0.01, floor: float = 0.001, least: int = 8) -> Column:
    """Whether a row stays: with ``least`` rows or more those under max(top * ratio, floor) go."""
    return (F.count("*").over(whole()) < least) | (score >= F.greatest(F.max(score).over(whole()) * ratio, F.lit(floor)))


def guaranteed(found: DataFrame, k: int, first: int = 10) -> DataFrame:
    """Top k, in which the ``first`` of either list always stay; others give way from the tail."""
    sure = (F.coalesce(F.col("dense_rank"), F.lit(1 << 30)) <= first) | (F.coalesce(F.col("bm25_rank"), F.lit(1 << 30)) <= first)
    rows = found.withColumn("rn", F.row_number().over(ordered())).withColumn("sure", sure)
    late = F.sum(F.when(F.col("sure") & (F.col("rn") > k), 1).otherwise(0)).over(whole())
    plain = F.sum(F.when(F.col("sure"), 0).otherwise(1)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    room = F.sum(F.when(~F.col("sure") & (F.col("rn") <= k), 1).otherwise(0)).over(whole()) - F.col("late")
    kept = rows.withColumn("late", late).where(F.col("sure") | (F.col("rn") <= k)).withColumn("plain", plain).withColumn("room", room)
    kept = kept.where(F.col("sure") | (F.col("plain") <= F.col("room")))
    return kept.withColumn("final_rank", F.row_number().over(ordered()).cast("long")).drop("rn", "sure", "late", "plain", "room")


def score_floor(score: Column, rank: Column, rel: float = 0.3, floor: float = 0.01, always: int = 3) -> Column:
    """The first ``always`` stay, later ones from max(floor, rel * best)."""
    return (rank <= always) | (score >= F.greatest(F.lit(floor), F.max(score).over(whole()) * rel))


def blend_scores(ce: Column, rrf_score: Column, w: float = 0.1) -> Column:
    """(1 - w) * ce + w * min(1, rrf / best rrf below 1)."""
    best = F.max(F.when(rrf_score < 1, rrf_score)).over(whole())
    return (1 - w) * ce + w * F.least(F.lit(1.0), F.coalesce(rrf_score / F.nullif(best, F.lit(0.0)), F.lit(0.0)))


def misclassified(score: Column, least: float, rel: float = 0.08, least_rows: int = 3, rn: Column | None = None) -> Column:
    """Whether a row stays: the absolute floor (all under it: the first row alone), then a relative one from top 0.10 on if enough rows survive it."""
    top = F.max(score).over(whole())
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")) if rn is None else rn
    over = F.sum((score >= least).cast("int")).over(whole())
    strict = (score >= least) & (score >= top * rel)
    enough = F.sum(strict.cast("int")).over(whole()) >= least_rows
    return F.when(over == 0, rn == 1).when((top >= 0.10) & enough, strict).otherwise(score >= least)


def cap_defer(found: DataFrame, group: str, position: str, cap: int = 3) -> DataFrame:
    """Rows of a group past ``cap`` move to the end in order; none is dropped. Adds ``place``."""
    n = F.row_number().over(Window.partitionBy("query_id", group).orderBy(position))
    late = found.withColumn("late", n > cap)
    return late.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("late", position)).cast("long")).drop("late")


def backfill(chosen: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Fills each query's rows up to k from the pool, best first, without what is there."""
    more = pool.join(chosen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = chosen.select("query_id", "doc_id", "score", F.lit(0).alias("filled")).unionByName(more.select("query_id", "doc_id", "score", F.lit(1).alias("filled")))
    w = Window.partitionBy("query_id").orderBy("filled", F.desc("score"), "doc_id")
    return both.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ranked arms in turn, the first place of an id counts."""
    both = a.select("query_id", "doc_id", "rank", F.lit(0).alias("arm")).unionByName(b.select("query_id", "doc_id", "rank", F.lit(1).alias("arm")))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank", "arm"))).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "arm")).cast("long"))


def balance_sources(found: DataFrame, source: str, k: int, least: int = 3, share: float = 0.5) -> DataFrame:
    """In the top k, each of two sources gets ``least`` rows if it has such of at least ``share`` of the best score.

    The last row of the other source gives way, never below ``least``. Sequential
    by nature; one query's candidates at a time.
    """

    def swap(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        top, rest = rows.head(k).copy(), rows.iloc[k:]
        best = rows["score"].max() if len(rows) else 0.0
        for kind in sorted(rows[source].unique()):
            while (top[source] == kind).sum() < least:
                into = rest[(rest[source] == kind) & (rest["score"] >= share * best)]
                others = top[top[source] != kind]
                counts = others[source].value_counts()
                out = others[others[source].map(counts) > least]
                if not len(into) or not len(out):
                    break
                row = into.iloc[:1]
                rest = rest.drop(row.index)
                top = pd.concat([top.drop(out.index[-1]), row])
        top = top.sort_values(["score", "doc_id"], ascending=[False, True])
        return top.assign(place=range(1, len(top) + 1))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.groupBy("query_id").applyInPandas(swap, f"{fields}, place bigint")


def greedy_dedup(found: DataFrame, words: str, likeness: float = 0.4) -> DataFrame:
    """Rows that resemble no better kept row of their query (``functions.text.duplicate_sets``), in score order."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        kept, sets = [], []
        for i, row in zip(rows.index, rows[words], strict=True):
            own = set(row)
            for other in sets:
                union, both, small = len(own | other), len(own & other), min(len(own), len(other))
                if union == 0 or both / union >= likeness or small >= 4 and both >= 0.75 * small or small >= 5 and both >= 0.6 * small:
                    break
            else:
                kept.append(i)
                sets.append(own)
        return rows.loc[kept]

    return found.groupBy("query_id").applyInPandas(keep, found.schema)
