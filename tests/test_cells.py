"""Vector search against all pairs."""

import numpy as np
import pytest

from wadi.operators import cells as C
from wadi.plans import retrieval


def table(spark, v, names="vec_id long, v array<float>"):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], names)


@pytest.mark.parametrize("part", [1000, 7])
def test_neighbours_are_exact(spark, part):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[3] * 2
    v[9] = 0
    unit = v.astype(np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = {}
    for i in range(60):
        scored = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(60) if j != i)
        want[i] = [j for s, j in scored if -s >= 0.3][:4]
    got = {}
    for r in C.neighbours(table(spark, [*v, None], "id long, v array<float>"), 0.3, 4, part).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {i: x for i, x in want.items() if x}


def test_cells_find_the_best(spark):
    """Clusters, a third of all vectors equal, cells in several parts; recall against all pairs."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    v = np.concatenate([centres[rng.integers(0, 12, 800)] + rng.normal(size=(800, 8)), np.tile(centres[0], (400, 1))]).astype(np.float32)
    vectors = table(spark, [*v, None])
    index = C.fit(vectors, sample=500)
    queries = vectors.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "v AS q")
    got = {}
    for r in C.search(index, queries, vectors, 10, part=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scores = np.round(v.astype(float) @ v.astype(float).T, 6)
    hits = total = 0
    for q in range(0, len(v), 10):
        best = np.sort(scores[q])[::-1][:10]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(abs(s - scores[q, j]) < 1e-9 for _, j, s in got[q])
        hits += sum(s >= best[-1] for _, _, s in got[q])
        total += 10
    assert hits / total >= 0.9
    few = C.search(index, queries.limit(0), vectors, 3)
    assert few.count() == 0 and C.search(C.fit(vectors.limit(0)), queries, vectors.limit(0), 3).count() == 0


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.knn_topk(spark, sf).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in retrieval.knn_cells(spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
