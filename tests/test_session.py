import cmath
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wadi.operators import audio
from wadi.operators import session as S


def plain_mel(samples, s):
    """Frame by frame and bin by bin, with a plain Fourier sum."""
    x = [float(v) * 32768 for v in samples]
    mel = lambda hz: 1127 * math.log(1 + hz / 700)
    corners = [mel(s.lowest) + (mel(s.highest) - mel(s.lowest)) * i / (s.mels + 1) for i in range(s.mels + 2)]
    rows = []
    for a in range(0, len(x) - s.frame + 1, s.hop):
        f = x[a : a + s.frame]
        m = sum(f) / len(f)
        f = [v - m for v in f]
        f = [(f[0] * (1 - s.preemphasis) if i == 0 else f[i] - s.preemphasis * f[i - 1]) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (s.frame - 1))) ** 0.85 for i in range(s.frame)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / s.fft) for i, v in enumerate(f))) ** 2 for k in range(s.fft // 2)]
        row = []
        for j in range(s.mels):
            total = 0.0
            for k, p in enumerate(power):
                b = mel(k * s.rate / s.fft)
                total += p * max(0.0, min((b - corners[j]) / (corners[j + 1] - corners[j]), (corners[j + 2] - b) / (corners[j + 2] - corners[j + 1])))
            row.append(math.log(max(total, s.floor)))
        rows.append(row)
    for j in range(s.mels):
        column = [r[j] for r in rows]
        mean = sum(column) / len(column)
        sd = math.sqrt(sum((c - mean) ** 2 for c in column) / len(column) + s.epsilon)
        for r in rows:
            r[j] = (r[j] - mean) / sd
    return [sum(rows[i : i + s.stack], []) for i in range(0, len(rows) // s.stack * s.stack, s.stack)]


def test_mel_features_against_plain_sums(spark):
    s = audio.MelSettings(frame=40, hop=16, fft=64, mels=8)
    wave = np.random.default_rng(2).uniform(-1, 1, 200).astype(np.float32)
    want = np.array(plain_mel(wave, s))
    for chunk in (1, 3, 4096):
        assert np.allclose(audio.log_mel(wave, s, chunk), want, atol=1e-4)
    rows = spark.createDataFrame([(1, wave.tolist()), (2, wave[:39].tolist()), (3, []), (4, None)], "i long, w array<float>")
    got = {r["i"]: r["m"] for r in rows.select("i", audio.mel_features(F.col("w"), s).alias("m")).collect()}
    assert np.allclose(got[1], want, atol=1e-4) and got[2] == got[3] == got[4] == []
    whole = audio.log_mel(np.zeros(16000))
    assert whole.shape == (49, 160) and np.abs(whole).max() < 1e-6


def test_chunks_and_refunds(spark):
    cases = {"قَاالَ": ["قَ", "اا", "لَ"], "اااا": ["اااا"], "": [], None: None, "xَ": [], "مممم بِّ": ["مممم", "بِ"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.phoneme_chunks(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases
    tokens = [([2, 1, 3], [10, 12, 20], 2, 4), ([2, 1, 3], [10, 12, 20], 3, 4), ([2, 1, 3], [10, 12, 20], 99, 0), ([2, 1, 3], [10], 99, 0), ([1], [5], 1, 9), ([1], [5], 0, 0), ([], [5], 1, 0), ([1], [], 1, 0)]
    want = [0.24, 0.32, 0.8, 0.4, 0.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(tokens)], "i int, l array<long>, f array<int>, c int, s int")
    got = rows.select("i", S.refunded_seconds(F.col("l"), F.col("f"), F.col("c"), F.col("s")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == pytest.approx(want)


def test_missing_targets_and_words_since_a_boundary(spark):
    entries = spark.createDataFrame([("a", 1), ("_c", 9), ("---", 9), ("b", 9), ("n", None)], "alias string, id long")
    known = spark.createDataFrame([(1,), (None,)], "id long")
    assert sorted(r["alias"] for r in S.missing_targets(entries, known, "alias", "id").collect()) == ["b", "n"]
    rows = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 3, 0), ("y", 1, 0), (None, 1, 1), (None, 2, 0)], "g string, at long, cut int")
    got = S.since_last(rows, "g", "at", F.col("cut") == 1).select("g", "at").collect()
    assert sorted(((r[0] or "", r[1]) for r in got)) == [("", 2), ("x", 3), ("y", 1)]


def test_vocabulary_by_lots_of_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "LOT", 8)
    rows = ["the cat the cat sat", "the cat", "The cat's", "x", "12 34 ..", "", None, "the cat", "a-b c' d"] + [f"word{i} of many" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    want = Counter()
    for t in {t for t in rows if t}:
        w = re.findall(r"[A-Za-z][A-Za-z'\-]*", t)
        want.update((1, x) for x in w if x == x.lower())
        want.update((k, " ".join(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    got = S.vocabulary(df, "text")
    assert {(r["size"], r["gram"]): r["n"] for r in got.collect()} == want
    # a task has a lot, and no function of arrays is applied to each word
    plan = got._jdf.queryExecution().executedPlan().toString()
    lots = sum(len(t.encode()) for t in rows if t) // 8 + 1
    assert f"{lots}), REPARTITION_BY_NUM" in plan and "lambdafunction" not in plan


def test_vocabulary_sends_longest_runs_by_their_last_words(spark):
    """The words that runs begin with are sent once a lot, not with each run; runs of one and of four words are counted too."""
    texts = [f"in the {a}{b} box is the {b}{a} cup" for a in "abcdefgh" for b in "klmnopqr"] * 2 + ["A", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for longest in (1, 2, 3, 4):
        want = Counter()
        for t in set(texts):
            w = t.split()
            want.update((1, x) for x in w if x == x.lower())
            want.update((k, " ".join(w[i : i + k])) for k in range(2, longest + 1) for i in range(len(w) - k + 1))
        got = S.vocabulary(df, "text", longest)
        assert {(r["size"], r["gram"]): r["n"] for r in got.collect()} == want
    # texts and runs are sent once each
    plan = S.vocabulary(df.localCheckpoint(), "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "key#" in plan.split("Exchange hashpartitioning(")[1]
    rows = list(S._counted([pa.array([["a", "b", "c"], ["a", "b", "d"], ["a", "b", "d"]])], 3))
    sent = [tuple(r.values()) for batch in rows for r in batch.to_pylist()]
    assert sent == [("a", ":3"), ("b", ":3"), ("c", ""), ("d", ":2"), ("a b", ":3 c d:2"), ("b c", ""), ("b d", ":2")]
