"""The index in chunks against plain scores."""

import math
import random
from collections import Counter

import pytest

from wadi.operators import bm25
from wadi.sources.shared import folder_of

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta"]


def corpus(rng, n=60):
    rows = [(i, " ".join(rng.choices(WORDS, [8, 6, 4, 2, 1, 1, 1], k=rng.randint(1, 12)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "a b"), (903, rows[0][1])]


def plain(docs, queries, k, scope=None, overlap=False):
    words = {i: [w for w in (t or "").lower().split() if len(w) > 2] or [str(i)] for i, t in docs}
    df = Counter(w for own in words.values() for w in set(own))
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, text in queries:
        scores = []
        for d, own in words.items():
            if scope is not None and d not in scope:
                continue
            tf = Counter(own)
            asked = Counter(text.split())
            s = sum((1 if overlap else n * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.35 + 0.65 * len(own) / mean))) for w, n in asked.items() if w in tf)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return {q: rows for q, rows in out.items() if rows}


@pytest.mark.parametrize("chunk, block", [(1 << 22, 256), (40, 2)])
def test_search(spark, tmp_path, monkeypatch, chunk, block):
    monkeypatch.setattr(bm25, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(bm25, "BLOCK", block)
    rng = random.Random(chunk)
    rows = corpus(rng)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token string").repartition(3)
    queries = [(q, " ".join(rng.choices(WORDS + ["none"], k=rng.randint(1, 5)))) for q in range(7)] + [(50, "none"), (51, "900")]
    qdf = spark.createDataFrame(queries, "query_id int, text string")
    index = bm25.open_index(docs, str(tmp_path / "index"))
    again = bm25.open_index(spark.createDataFrame([], docs.schema), str(tmp_path / "index"))
    assert index.n == again.n == len(rows)
    scope = {i for i, _ in rows if i % 2}
    sdf = spark.createDataFrame([(i,) for i in scope], "doc_id long")
    for ix in (index, again):
        for k in (3, 100):
            for limit, given in ((None, None), (scope, sdf)):
                got = {}
                for r in bm25.search(ix, bm25.query_tokens(qdf), k, given).orderBy("query_id", "rank").collect():
                    got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
                want = plain(rows, queries, k, limit)
                assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
                assert all(a[1] == pytest.approx(b[1], abs=2e-6) for q in got for a, b in zip(got[q], want[q], strict=True))
    got = {}
    for r in bm25.search_overlap(index, bm25.query_tokens(qdf), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == plain(rows, queries, 5, overlap=True)


def test_empty_corpus_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha")], "query_id int, text string")
    index = bm25.build(docs, str(tmp_path / "none"))
    assert index.n == 0 and bm25.search(index, bm25.query_tokens(queries), 3).count() == 0
    some = bm25.build(spark.createDataFrame([(1, "alpha beta")], docs.schema), str(tmp_path / "some"))
    assert bm25.search(some, bm25.query_tokens(queries.limit(0)), 3).count() == 0


def test_folder_changes_with_the_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(3).write.parquet(path)
    one = folder_of(spark.read.parquet(path), "bm25")
    assert one == folder_of(spark.read.parquet(path), "bm25")
    spark.range(3).write.mode("append").parquet(path)
    assert one != folder_of(spark.read.parquet(path), "bm25")


def test_chunks_are_bounded_by_their_words(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word other "), 150_000), F.lit("own"), F.col("id").cast("string")).alias("text"))
    index = bm25.build(docs, f"file://{tmp_path}/index")
    words = [sum(r["lengths"]) for r in index.chunks.collect()]
    assert len(words) == 2 and max(words) <= 1 << 20 and sum(words) == 6 * 300_001
    query = spark.createDataFrame([(1, "own4")], "query_id long, text string")
    assert [r["doc_id"] for r in bm25.search(index, bm25.query_tokens(query), 3).collect()] == [4]
