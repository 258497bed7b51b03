"""Score adjustments of fused candidates, as one chain of columns.

A candidate row has: query_type, source_type, score, dense_rank, bm25_rank (null where
an arm lacks it), window_size, anchor_pos (0-based place of the first dense hit among a
window's members), short_reference (a body of under 15 words that only refers to
another), event_intent, off_topic_event, checked and matched (names or words of
a story that were looked for, and found), entities and entities_matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights, windows and caps of the rules.
RRF_K = 60
WINDOW_NORMAL, WINDOW_DEFINITIONAL = 13, 6
CLUSTER, CLUSTER_LEGAL, SHORT_REFERENCE = 0.3, 0.2, 0.15
EVENT_REPORT, EVENT_OFF_TOPIC, EVENT_LARGE = 1.4, 0.35, 0.65
COMMENTARY, LARGE_WINDOW = 0.85, 0.8
MISMATCH_BOOK, MISMATCH_REPORT = 0.3, 0.35
RANK_1, ONLY_CAP, BOTH_SIDES = 3.0, 0.008, 1.5

BOOK, REPORTS = ("Quran_Tafsir", "Quran_Passage"), ("Hadith", "Hadith_Cluster")


def factors() -> list[Column]:
    """The multiplicative rules in their order; each is 1 where it does not apply."""
    c = F.col
    kind, source = c("query_type"), c("source_type")
    passage, story = source == "Quran_Passage", kind == "narrative"
    legal, defining = kind == "fiqh", kind == "definitional"
    window, anchor = c("window_size"), c("anchor_pos")
    wide = F.when(passage, window).otherwise(1) >= WINDOW_NORMAL
    tail = passage & (legal | defining) & (window >= 4) & (anchor >= F.floor(window * 2 / 3))
    lonely = F.when(legal, c("dense_rank") <= 30).when(defining, F.lit(True)).otherwise(c("dense_rank").isNull() | (c("dense_rank") <= 30))
    boosted = kind.isin("arabic_keyword", "exact_arabic", "definitional", "fiqh") & (c("bm25_rank") == 1) & lonely
    rules = [
        F.when(source == "Hadith_Cluster", F.when(legal, CLUSTER_LEGAL).otherwise(CLUSTER)),
        F.when(source.isin(*REPORTS) & c("short_reference"), SHORT_REFERENCE),
        F.when(c("event_intent") & (source == "Hadith"), F.when(c("off_topic_event"), EVENT_OFF_TOPIC).otherwise(EVENT_REPORT)).when(c("event_intent") & source.isin(*BOOK) & wide, EVENT_LARGE),
        F.when((source == "Quran_Tafsir") & ~kind.isin("arabic_keyword", "exact_arabic"), COMMENTARY),
        F.when(passage & defining & (window > WINDOW_DEFINITIONAL), F.greatest(F.lit(0.5), 0.95 - (window - WINDOW_DEFINITIONAL) * 0.05)).when(passage & ~story & ~defining & (window >= WINDOW_NORMAL), LARGE_WINDOW),
        F.when(tail, F.greatest(F.lit(0.55), 0.85 - anchor / window * 0.35)),
        F.when(story & source.isin(*BOOK) & (c("checked") >= 1) & (c("matched") == 0), MISMATCH_BOOK).when(story & (source == "Hadith") & (c("entities") >= 1) & (c("entities_matched") == 0), MISMATCH_REPORT),
        F.when(boosted, RANK_1),
    ]
    return [F.coalesce(r.cast("double"), F.lit(1.0)) for r in rules]


def adjusted(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``score`` multiplied and capped, and ``mismatch`` for stories that miss what was asked."""
    kind = F.col("query_type")
    only = F.col("dense_rank").isNull() & F.col("bm25_rank").isNotNull()
    score = reduce(lambda a, b: a * b, factors(), F.col("score"))
    capped = only & ((kind == "fiqh") | ((kind == "definitional") & (F.col("bm25_rank") > 5)))
    off = F.col("event_intent") & (F.col("source_type") == "Hadith") & F.col("off_topic_event")
    missed = (kind == "narrative") & ((F.col("source_type").isin(*BOOK) & (F.col("checked") >= 1) & (F.col("matched") == 0)) | ((F.col("source_type") == "Hadith") & (F.col("entities") >= 1) & (F.col("entities_matched") == 0)))
    return candidates.withColumn("mismatch", F.coalesce(off | missed, F.lit(False))).withColumn("score", F.when(capped, F.least(score, F.lit(ONLY_CAP))).otherwise(score))


def lexical_floor(candidates: DataFrame, dense_weight: Column) -> DataFrame:
    """Raises early hits of the lexical arm alone to a share of what a dense rank of 30 brings; not for legal queries."""
    kind, rank = F.col("query_type"), F.col("bm25_rank")
    floor = dense_weight / (RRF_K + 30) * F.when(kind == "definitional", 0.8).otherwise(0.6 - (rank - 1) * 0.05)
    on = (kind != "fiqh") & F.col("dense_rank").isNull() & (rank <= F.when(kind == "definitional", 20).otherwise(10))
    return candidates.withColumn("score", F.when(on, F.greatest("score", floor)).otherwise(F.col("score")))


def without_references(candidates: DataFrame, pattern: str) -> DataFrame:
    """Without single reports whose translation is under 80 characters and only refers to another."""
    text = F.trim(F.coalesce("translation", F.lit("")))
    return candidates.where(~((F.col("source_type") == "Hadith") & (F.length(text) > 0) & (F.length(text) < 80) & text.rlike(pattern)))


def both_sides(score: Column, text: Column, a: Column, b: Column) -> Column:
    """Boosts texts that hold a word of three letters and more of either side."""
    long = lambda words: F.filter(words, lambda w: F.length(w) >= 3)
    has = lambda words: F.exists(long(words), lambda w: F.contains(text, w))
    return F.when(has(a) & has(b), score * BOTH_SIDES).otherwise(score)


def side_score(score: Column, sides: list[Column]) -> Column:
    """The better of the whole score and half the best plus half the mean of the sides'."""
    return F.greatest(score, 0.5 * F.greatest(*sides) + 0.5 * reduce(lambda x, y: x + y, sides) / len(sides))


def best_score(rerank: Column, fused: Column) -> Column:
    return F.coalesce(rerank, fused, F.lit(0.0))


def keep_if_enough(rows: DataFrame, flag: str, by: str = "query_id", least: int = 2) -> DataFrame:
    """Drops flagged rows of a query where at least ``least`` others stay."""
    left = F.sum((~F.col(flag)).cast("int")).over(Window.partitionBy(by))
    return rows.withColumn("_left", left).where(~F.col(flag) | (F.col("_left") < least)).drop("_left")


def representative(rows: DataFrame, group: str, priority: str, scores: list[str]) -> DataFrame:
    """The row of least priority of every group, each score the greatest of the group's."""
    kept = [c for c in rows.columns if c not in (group, *scores)]
    best = F.min(F.struct(priority, *[c for c in kept if c != priority])).alias("b")
    return rows.groupBy(group).agg(best, *[F.max(s).alias(s) for s in scores]).select(group, *[F.col(f"b.{c}").alias(c) for c in kept], *scores)


def stem_caps(rows: DataFrame, per_stem: Column, total: Column) -> DataFrame:
    """Rows (query_id, place, stem, single, anchored) with at most ``per_stem`` of a stem and ``total`` single ones of a query.

    Others and anchored ones always stay; anchored ones count for the total. The
    cap by stem is taken first, in the order of the places.
    """
    counted = F.col("single") & ~F.col("anchored") & F.col("stem").isNotNull()
    of_stem = F.row_number().over(Window.partitionBy("query_id", counted, "stem").orderBy("place"))
    within = rows.withColumn("_s", of_stem).where(~counted | (F.col("_s") <= per_stem))
    before = F.sum(F.col("single").cast("int")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return within.withColumn("_b", F.coalesce(before, F.lit(0))).where(~F.col("single") | F.col("anchored") | (F.col("_b") < total)).drop("_s", "_b")


def leading_run(rows: DataFrame, group: str, number: str, k: int) -> DataFrame:
    """The rows numbered 1, 2, ... of every group up to the first gap, ``k`` at most."""
    near = rows.where(F.col(number).between(1, k))
    place = F.row_number().over(Window.partitionBy(group).orderBy(number))
    return near.withColumn("place", place).where(F.col("place") == F.col(number))


def inject(rows: DataFrame, hints: DataFrame, score: float = 9999.0) -> DataFrame:
    """``rows`` (query_id, doc_id, score) with the hinted pairs that are not among them, at the head."""
    new = hints.select("query_id", "doc_id").distinct().join(rows.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return rows.select("query_id", "doc_id", "score").unionByName(new.withColumn("score", F.lit(score)))


def first_attempt(rows: DataFrame, by: str = "query_id", attempt: str = "attempt") -> DataFrame:
    """Of several attempts of a query, the rows of the first that has any."""
    return rows.withColumn("_first", F.min(attempt).over(Window.partitionBy(by))).where(F.col(attempt) == F.col("_first")).drop("_first")
