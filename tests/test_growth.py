"""What must not grow with the tables: broadcasts, repeated work, rows between tasks."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wadi.functions import phonetics as P
from wadi.functions import vectors as V
from wadi.operators import cells
from wadi.operators import shaping as S
from wadi.plans import catalog, concepts

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _spans(spark):
    return spark.createDataFrame([(1, 1, 0, 2), (1, 2, 2, 3), (2, 1, 5, 6)], "group long, word int, start int, end int")


def test_mapped_bounds_broadcasts_nothing(spark):
    chars = spark.range(1, 3).selectExpr("id AS group", "explode(sequence(0, 3)) AS at").selectExpr("group", "at", "at * 2 AS to", "at = 0 AS deleted")
    got = S.mapped_bounds(_spans(spark), chars)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 2), (1, 2, 4, 4), (2, 1, None, None)]
    assert "Broadcast" not in _plan(got)


def test_spans_of_chunks_broadcasts_nothing(spark):
    chunks = spark.range(1, 3).selectExpr("id AS group", "explode(sequence(0, 3)) AS c_start").selectExpr("group", "c_start", "1 AS size", "concat('c', c_start) AS chunk")
    got = S.spans_of_chunks(_spans(spark), chunks)
    assert sorted(map(tuple, got.collect())) == [(1, 1, ["c0", "c1"]), (1, 2, ["c2"]), (2, 1, [])]
    assert "Broadcast" not in _plan(got)


def test_phonetic_ends_are_ends_of_the_text(spark):
    """As in the SQL: no end before a last line feed, and a carriage return is a character."""
    cases = [("word_end", "\u0628\u064e\n", "\u0628\u064e\n"), ("echo", "\u0642\n", "\u0642\n"), ("doubled", "\r\u0651", "\r\r"), ("word_end", "\n\u0628\u064e", "\n\u0628")]
    for group, text, want in cases:
        assert spark.range(1).select(P.phonetic(F.lit(text), (group,))).first()[0] == want
    assert re.search(concepts.MAPPED[[new for _, new in concepts.MAPPED].index(rf"\1{P.ECHO}")][0], "\u0642\n") is None


def test_exact_search_with_copies_nulls_and_ties(spark):
    """Copies beyond k, null vectors and queries, equal scores: as all pairs in plain Python; parts of any size."""
    draw = random.Random(5)
    some = [[draw.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, None if i % 17 == 3 else some[i % 5 if i % 3 else i % 30], i % 3 if i % 11 else None) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
    q = spark.createDataFrame([(i, x) for i, x, _ in rows if i % 7 == 3], "query_id long, q array<double>")
    for part in (16, 1000):
        for strata, others in ((False, False), (True, True)):
            want = []
            for i, x, _ in rows:
                if i % 7 == 3:
                    groups = {}
                    for j, y, label in rows:
                        if not (others and i == j):
                            score = None if x is None or y is None else round(sum(a * b for a, b in zip(x, y, strict=True)), 6)
                            groups.setdefault(label if strata else 0, []).append((score is None, -(score or 0), j, label, score))
                    for g in groups.values():
                        want += [(i, j, label, score, r) for r, (_, _, j, label, score) in enumerate(sorted(g, key=lambda t: t[:3])[:4], 1)]
            got = cells.nearest(q, v, 4, "label", strata, others, part).select("query_id", "vec_id", "label", "score", "rank").collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_neighbours_and_searches_take_products_of_matrices(spark):
    """No search has a row for each pair; 20,000 vectors are one block of ``neighbours``, so each is sent twice."""
    v = spark.range(20_000).selectExpr("id", "array(float(sin(id)), float(cos(id * 3))) AS v")
    assert re.search(r"xxhash64\(.*\), 1\) AS block", _plan(cells.neighbours(v, 0.9, 2)))
    for name in ("knn_topk", "knn_scoped_topk", "knn_stratified", "dense_best_merge", "precision_recall_mrr"):
        plan = _plan(catalog.QUERIES[name](spark, SF))
        assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_softmax_works_its_parts_out_once(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 3.0],)], "v array<double>")
    got = rows.select(V.softmax(F.col("v")).alias("p"), V.log_sum_exp(F.col("v")).alias("lse"), V.unit(F.col("v")).alias("u"))
    p, lse, u = got.first()
    total = sum(math.exp(x) for x in (0, 1, 3))
    assert p == pytest.approx([math.exp(x) / total for x in (0, 1, 3)]) and lse == pytest.approx(math.log(total)) and u == pytest.approx([0, 0.1**0.5, 0.9**0.5])
    assert _plan(rows.select(V.softmax(F.col("v")).alias("x"))).count("array_max(") == 1
    assert _plan(rows.select(V.unit(F.col("v")).alias("x"))).count("SQRT(") == 1


def test_own_words_start_reads_kinds_of_opened_texts_only(spark):
    plan = _plan(catalog.QUERIES["own_words_start"](spark, SF))
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract" in x]


def test_word_spans_in_one_pass(spark):
    rows = spark.createDataFrame([(" a b \U0001F600c\r\nd",), ("",), (None,), ("x " * 50_000,)], "t string").select(S.word_spans(F.col("t")).alias("s"))
    assert "aggregate(" not in _plan(rows)
    got = [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in rows.collect()]
    assert got[:3] == [[("a b", 1, 4), ("\U0001F600c", 5, 7), ("d", 9, 10)], [], None] and got[3][-1] == ("x", 99_998, 99_999) and len(got[3]) == 50_000
