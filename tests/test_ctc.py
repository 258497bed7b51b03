"""CTC over tables of frames, against all alignments of short utterances."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wadi.operators import ctc as C
from wadi.operators.sequences import collapse, ctc_beam, forced_align, log_softmax

SCHEMA = "utterance long, frame int, logits array<double>, rank int"


def logits(probs):
    return [math.log(max(p, 1e-9)) for p in probs]


def table(spark, utterances):
    return spark.createDataFrame([(u, t, list(map(float, x)), 9) for u, frames in utterances.items() for t, x in enumerate(frames)], SCHEMA)


def all_alignments(frames):
    """Mass of every label sequence, over all paths."""
    logs = log_softmax(np.array(frames, float))
    mass = {}
    for path in itertools.product(range(logs.shape[1]), repeat=len(logs)):
        key = tuple(collapse(list(path)))
        mass[key] = mass.get(key, 0.0) + math.exp(sum(logs[t, k] for t, k in enumerate(path)))
    return mass


def draw(rng, n, symbols=4):
    return [[rng.gauss(0, 2) for _ in range(symbols)] for _ in range(n)]


@pytest.mark.parametrize("lot, kept", [(C.LOT, C.KEPT), (1, 3)])
def test_best_against_all_alignments(spark, monkeypatch, lot, kept):
    monkeypatch.setattr(C, "LOT", lot)
    monkeypatch.setattr(C, "KEPT", kept)
    rng = random.Random(3)
    utterances = {u: draw(rng, rng.randint(1, 5)) for u in range(20)}
    rows = [(u, f) for u, frames in utterances.items() for f in frames]
    for size in (3, 1000):  # an utterance may go over any number of batches
        batches = [pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows[i : i + size]]), pa.array([f for _, f in rows[i : i + size]], pa.list_(pa.float64()))], names=["u", "l"]) for i in range(0, len(rows), size)]
        got = {}
        for b in C._best(iter(batches), 500, 5, 0):
            for u, r, s, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(u, []).append((r, tuple(s), p))
        assert set(got) == set(utterances)
        for u, frames in utterances.items():
            want = sorted(all_alignments(frames).items(), key=lambda x: -x[1])[:5]
            assert [r for r, _, _ in got[u]] == list(range(len(want)))
            assert [s for _, s, _ in got[u]] == [s for s, _ in want]
            assert [math.exp(p) for _, _, p in got[u]] == pytest.approx([p for _, p in want])


def test_table_of_frames(spark):
    rng = random.Random(5)
    utterances = {1: [logits([0.6, 0.4, 0.0]), logits([0.6, 0.4, 0.0])], 2: draw(rng, 60, 3), 3: draw(rng, 1, 3)}
    df = table(spark, utterances).union(spark.createDataFrame([(4, 0, None, 1), (None, 0, [0.0, 0.0, 0.0], 1)], SCHEMA))
    got = C.n_best(df, width=20, n=4).orderBy("utterance", "rank").collect()
    assert {r["utterance"] for r in got} == {1, 2, 3}
    first = [r for r in got if r["utterance"] == 1]
    assert first[0]["symbols"] == [1] and first[0]["log_prob"] == pytest.approx(math.log(0.64)) and len(first) >= 2
    plain = ctc_beam(np.exp(log_softmax(np.array(utterances[2]))), 20, 4)
    assert [(tuple(r["symbols"]), r["log_prob"]) for r in got if r["utterance"] == 2] == [(s, pytest.approx(p)) for s, p in plain]
    assert C.n_best(df.limit(0)).count() == 0


def test_forced_alignment(spark):
    rng = random.Random(6)
    utterances = {u: draw(rng, rng.randint(1, 6), 3) for u in range(30)}
    targets = {u: [rng.randint(1, 2) for _ in range(rng.randint(0, 3))] for u in range(28)}
    df = table(spark, utterances)
    tdf = spark.createDataFrame(list(targets.items()), "utterance long, target array<int>")
    got = {}
    for r in C.forced_alignment(df, tdf).orderBy("utterance", "frame").collect():
        got.setdefault(r["utterance"], []).append(r["symbol"])
    for u, target in targets.items():
        logs = log_softmax(np.array(utterances[u]))
        paths = [p for p in itertools.product(range(3), repeat=len(logs)) if collapse(list(p)) == target]
        assert (u in got) == bool(paths)
        if paths:
            score = lambda p: sum(logs[t, k] for t, k in enumerate(p))  # noqa: E731, B023
            assert collapse(got[u]) == target and score(got[u]) == pytest.approx(max(map(score, paths)))
            assert got[u] == forced_align(np.exp(logs), target)
    assert 28 not in got and 29 not in got
    runs = C.spelled(C.forced_alignment(df, tdf)).collect()
    assert sum(1 for r in runs if r["utterance"] in got) == sum(len(targets[u]) for u in got)


def test_nearest_to_what_was_expected(spark):
    best = spark.createDataFrame([(1, 0, "kab"), (1, 1, "kat"), (1, 2, "cat"), (2, 0, "x"), (2, 1, "y")], "utterance long, rank int, text string")
    expected = spark.createDataFrame([(1, "c at"), (2, "zz")], "utterance long, expected string")
    got = {r["utterance"]: r["text"] for r in C.nearest(best, expected).collect()}
    assert got == {1: "cat", 2: "x"}
