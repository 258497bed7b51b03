"""Arms in one search, and scorers."""

from wadi.operators import arms, bm25

DOCS = [(1, "alpha beta"), (2, "beta gamma gamma"), (3, "delta"), (4, None), (5, "alpha alpha delta")]


def test_arms_are_searched_as_if_alone(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = bm25.build(docs, str(tmp_path / "index"))
    rows = [(1, "a", "alpha"), (1, "b", "gamma delta"), (2, 'odd "arm"', "beta"), (3, "a", "none"), (4, "a", None)]
    queries = spark.createDataFrame(rows, "query_id long, arm string, text string")
    found = arms.search_arms(index, queries, 2)
    got = {}
    for r in found.collect():
        got.setdefault((r["query_id"], r["arm"]), []).append((r["rank"], r["doc_id"], r["score"]))
    for q, arm, text in rows:
        alone = spark.createDataFrame([(q, text)], "query_id long, text string")
        want = [(r["rank"], r["doc_id"], r["score"]) for r in bm25.search(index, bm25.query_tokens(alone), 2).collect()]
        assert sorted(got.get((q, arm), [])) == sorted(want)
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")
    assert scans(found) == scans(bm25.search(index, bm25.query_tokens(alone), 2))  # no scan more for more arms
    best = {(r["query_id"], r["doc_id"]): r["arms"] for r in arms.best_arm(found).collect()}
    assert best[1, 5] == ["a"] and best[1, 2] == ["b"] and best[2, 2] == ['odd "arm"']


def test_only_missing_pairs_are_scored(spark):
    pool = spark.createDataFrame([(1, 1, "a b", "b c"), (1, 2, "a b", None), (2, 1, None, "x"), (2, 2, "x y", "y x z")], "query_id int, doc_id int, query string, passage string")
    known = spark.createDataFrame([(2, 2, 0.25), (2, 2, 0.125), (9, 9, 1.0)], "query_id int, doc_id int, score double")
    calls = spark.sparkContext.accumulator(0)

    def scorer():
        run = arms.overlap_scorer()

        def counted(queries, passages):
            calls.add(len(queries))
            return run(queries, passages)

        return counted

    got = {(r["query_id"], r["doc_id"]): (r["score"], r["fresh"]) for r in arms.score_pool(pool, known, scorer).collect()}
    assert got == {(1, 1): (0.5, True), (1, 2): (0.0, True), (2, 1): (0.0, True), (2, 2): (0.25, False)} and calls.value == 3
    assert arms.score_pool(pool.limit(0), known, scorer).count() == 0
