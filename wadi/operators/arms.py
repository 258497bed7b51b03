"""Queries of several arms in one plan, and scorers that are loaded once and score only what is not scored yet.

An arm is a part or a wording of a query that is searched for itself. All arms of all
queries are one batch, so the index is read once whatever their number.

A scorer is a function that makes a function from two lists of texts (queries, passages)
to scores; a task makes it once, for all of its batches (a model is loaded there). Pairs
that a table of known scores has keep those, the others are scored. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wadi.functions.memory import release
from wadi.operators import bm25

Scorer = Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]


def search_arms(index: bm25.Index, queries: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, arm, doc_id, score, rank): the best k of every arm (query_id, arm, text), from one search."""
    both = F.to_json(F.struct("query_id", "arm"))
    found = bm25.search(index, bm25.query_tokens(queries.select(both.alias("query_id"), "text")), k, scope)
    key = F.from_json("query_id", f"query_id {queries.schema['query_id'].dataType.simpleString()}, arm {queries.schema['arm'].dataType.simpleString()}")
    return found.withColumn("_key", key).select(F.col("_key.query_id").alias("query_id"), F.col("_key.arm").alias("arm"), "doc_id", "score", "rank")


def best_arm(found: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, arms): each document once with its best score and the arms that found it, in order."""
    return found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("arm")).alias("arms"))


def score_column(scorer: Scorer) -> Callable[[Column, Column], Column]:
    """Column function (query, passage) by Arrow batches."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = scorer()
        for query, passage in pairs:
            yield pd.Series(run(query.fillna("").tolist(), passage.fillna("").tolist()), dtype="float64")
        query = passage = None
        release()

    return score


def score_pool(pool: DataFrame, known: DataFrame, scorer: Scorer) -> DataFrame:
    """(query_id, doc_id, score, fresh) of a pool (query_id, doc_id, query, passage): known scores (query_id, doc_id, score) stay, the other pairs are scored."""
    keys = ["query_id", "doc_id"]
    old = known.groupBy(*keys).agg(F.max("score").alias("score"))
    kept = pool.select(*keys).join(old, keys).withColumn("fresh", F.lit(False))
    missing = pool.join(old.select(*keys), keys, "left_anti")
    return kept.unionByName(missing.select(*keys, score_column(scorer)(F.col("query"), F.col("passage")).alias("score"), F.lit(True).alias("fresh")))


def overlap_scorer() -> Callable[[Sequence[str], Sequence[str]], list[float]]:
    """The share of a query's distinct words that a passage has; stands for a model."""

    def run(queries: Sequence[str], passages: Sequence[str]) -> list[float]:
        out = []
        for q, p in zip(queries, passages, strict=True):
            own = set(q.split())
            out.append(len(own & set(p.split())) / len(own) if own else 0.0)
        return out

    return run
