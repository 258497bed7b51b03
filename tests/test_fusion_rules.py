"""Rules on the candidates of one query, against plain loops; approximate counts against exact ones."""

import random

from pyspark.sql import functions as F

from wadi.operators import fusion, shaping
from wadi.plans import quality
from wadi.plans.tables import table


def candidates(rng, queries=40):
    return [(q, d, rng.randint(1, 20) / 20, rng.choice(["en", "en", "en", "other"])) for q in range(queries) for d in range(rng.randint(1, 14))]


def plain_balance(rows, k=6, least=3, share=0.5):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    top, rest, best = rows[:k], rows[k:], rows[0][2]
    for kind in sorted({r[3] for r in rows}):
        while sum(r[3] == kind for r in top) < least:
            enter = next((r for r in rest if r[3] == kind and r[2] >= share * best), None)
            leave = next((r for r in reversed(top) if r[3] != kind and sum(x[3] == r[3] for x in top) > least), None)
            if enter is None or leave is None:
                break
            rest.remove(enter)
            top.remove(leave)
            top.append(enter)
    return [(r[1], i + 1) for i, r in enumerate(sorted(top, key=lambda r: (-r[2], r[1])))]


def test_balance_sources(spark):
    rows = candidates(random.Random(4))
    df = spark.createDataFrame(rows, "query_id int, doc_id int, score double, kind string")
    got = {}
    for r in fusion.balance_sources(df, "kind", 6).collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["place"]))
    for q in range(40):
        assert sorted(got[q], key=lambda x: x[1]) == plain_balance([r for r in rows if r[0] == q])


def test_greedy_dedup(spark):
    rng = random.Random(6)
    rows = [(q, d, s, [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 8))]) for q, d, s, _ in candidates(rng)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, score double, words array<string>")
    got = {(r["query_id"], r["doc_id"]) for r in fusion.greedy_dedup(df, "words").collect()}
    want = set()
    for q in range(40):
        kept = []
        for _, d, _, words in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            a = set(words)
            alike = False
            for b in kept:
                both, small = len(a & b), min(len(a), len(b))
                alike |= not a | b or both >= 0.4 * len(a | b) or small >= 4 and both >= 0.75 * small or small >= 5 and both >= 0.6 * small
            if not alike:
                kept.append(a)
                want.add((q, d))
    assert got == want


def test_approximate_counts_are_near_the_exact_ones(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["l_returnflag"]: r["parts"] for r in quality.approx_distinct(spark, sf).collect()}
    exact = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n")).collect()
    assert set(got) == {r["l_returnflag"] for r in exact} and all(abs(got[r["l_returnflag"]] - r["n"]) <= 0.05 * r["n"] for r in exact)


def test_trailing_runs_and_summaries(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice("aab")) for i in range(60)] + [(9, 100, "a")]
    df = spark.createDataFrame(rows, "g int, at int, v string")
    got = {r["g"]: r["run"] for r in shaping.trailing_runs(df, "g", "at", "v").collect()}
    sums = {r["g"]: r["summary"] for r in shaping.summaries(df, "g", "at", 3).collect()}
    for g in {r[0] for r in rows}:
        own = [v for k, _, v in rows if k == g]
        run = next((i for i, v in enumerate(reversed(own)) if v != own[-1]), len(own))
        at = [str(i) for k, i, _ in rows if k == g]
        assert got[g] == run and sums[g] == ", ".join(at[:3]) + (f" +{len(at) - 3}" if len(at) > 3 else "")
    assert len(got) == len(sums) == 5 and shaping.trailing_runs(df.limit(0), "g", "at", "v").count() == 0


def test_batches(spark):
    rng = random.Random(12)
    rows = [(rng.choice([0, 1, None]), i, rng.choice([None, *range(1, 30)]), 5) for i in range(150)]
    df = spark.createDataFrame(rows, "lot int, id int, n int, batch int")
    got = {r["id"]: (r["lot"], r["batch"]) for r in shaping.batches(df, "lot", "n", 60, 5).collect()}
    for lot in (0, 1, None):
        number, count = 0, 0
        for n, i in sorted((n or 0, i) for k, i, n, _ in rows if k == lot):
            if count >= 5 or count and n * (count + 1) > 60:
                number, count = number + 1, 0
            count += 1
            assert got[i] == (lot, number)
    assert len(got) == 150 and shaping.batches(df.limit(0), "lot", "n", 60).count() == 0
