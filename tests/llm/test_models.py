import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_text_and_fingerprints import brute_words
from wadi.llm import suffix_tree as S
from wadi.llm import toxicity as T


def brute_segments(sc):
    out = []

    def rec(a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += sc[j]
                if t > 1e-12 and (best is None or t > best[2] + 1e-12):
                    best = (i, j + 1, t)
        if best:
            rec(a, best[0])
            out.append(best)
            rec(best[1], b)

    rec(0, len(sc))
    return out


def test_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sc = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() * 0.01 for _ in range(rng.randint(1, 25))])
        assert [(a, b) for a, b, _ in T.maximal_segments(sc)] == [(a, b) for a, b, _ in brute_segments(sc)]
    assert T.maximal_segments(np.zeros(0)) == []


def labelled(docs, spark, n=300):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(400)]
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                words[rng.randrange(60)] = "nasty" + rng.choice(["one", "two", "three"])
        rows.append(" ".join(words))
        marks.append((i, int(bad)))
    return docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_toxicity_on_held_out_rows(docs, spark):
    d, labels, truth = labelled(docs, spark)
    fitted = T.fit(d, labels)
    got = T.score(d, fitted).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    kept = {r["doc_id"] for r in T.drop_toxic(d, labels).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}
    # a prefix that training saw carries over to words that it did not
    new = T.score(docs(["alpha nastyfour beta nastyfive gamma nastysix delta nastyseven", None, "", "alpha beta"]), fitted).orderBy("doc_id").collect()
    assert [r["predicted"] for r in new] == [1, 0, 0, 0]


def test_frequent_tokens_have_finite_odds():
    import pyarrow as pa

    from wadi.llm.textcore import NON_ALNUM, Words

    words = Words(pa.array(["worthless text"]), NON_ALNUM)
    kept = [(level, int(h.view(np.int64)), 10**7, 10**7) for level, at, hashes in T._levels(words) for i, h in zip(at, hashes, strict=True) if i == 0]
    odds = T.Model(pd.DataFrame(kept, columns=["level", "token", "toxic", "total"]), 10**8, 10**9).score(words)
    assert np.isfinite(odds).all() and odds[0] > 3 > odds[1]


def test_calibration_converges_on_unscaled_inputs():
    rng = np.random.default_rng(5)
    for scale in (1.0, 600.0):
        y = (rng.random(4000) < 0.1).astype(float)
        x = np.column_stack([rng.exponential(scale, 4000) * (y + 0.01) - 2, np.log1p(rng.exponential(scale, 4000)) * y])
        w = T.fit_logistic(x, y)
        predicted = w[0] + x @ w[1:] >= 0
        assert np.isfinite(w).all() and predicted[y == 1].mean() > 0.9 and predicted[y == 0].mean() < 0.02


def test_held_out_quality_of_the_query(spark):
    for sf, least in (("sf0.01", 0.8), ("sf0.1", 0.9)):
        got = T.op5_toxicity(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
        caught = got[got["toxic"] == 1]["predicted"].mean()
        right = got[got["predicted"] == 1]["toxic"].mean()
        assert caught >= least and right >= 0.9


def test_toxicity_without_labels(docs, spark):
    d, labels, _ = labelled(docs, spark, 20)
    assert T.fit(d, labels.where("toxic = 0")) is None
    assert {r["score"] for r in T.score(d, None).collect()} == {0.0}
    assert T.drop_toxic(d, labels.where("toxic = 0")).count() == 20
    assert T.score(docs([]), None).count() == 0


def test_suffix_tree_counts_and_base(docs):
    rng = random.Random(9)
    rows = [None, "", "A  b\nC"] + [" ".join(rng.choice(["the", "cat", "Sat", "on", "mats", "été"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = {r["doc_id"]: r for r in S.score(docs(rows)).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))}
    counts = {}
    for i, t in enumerate(rows):
        if not held[i]:
            for w in [*brute_words(t), "\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(rows):
        w = [*brute_words(t), "\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-9
        assert r["score"] < 0


class PlainTree:
    """Kept contexts in dictionaries; P by the longest kept suffix, each smoothed with the next shorter kept one."""

    def __init__(self, keys, depth, gain=S.GAIN, mass=S.MASS):
        self.depth, self.mass, seen = depth, mass, {}
        for k in keys:
            for level in range(depth + 1):
                c = seen.setdefault((level, (k >> 8) & ((1 << 8 * level) - 1)), {})
                c[k & 255] = c.get(k & 255, 0) + 1
        self.kept = {}
        for (level, c), n in seen.items():
            total = sum(n.values())
            if level:
                up = seen[level - 1, c & ((1 << 8 * (level - 1)) - 1)]
                if sum(m * math.log(m / total * sum(up.values()) / up[x]) for x, m in n.items()) < gain:
                    continue
            self.kept[level, c] = n

    def p(self, key, level=None):
        level = self.depth if level is None else level
        while level >= 0 and (level, key >> 8 & ((1 << 8 * level) - 1)) not in self.kept:
            level -= 1
        if level < 0:
            return 1 / 256
        n = self.kept[level, key >> 8 & ((1 << 8 * level) - 1)]
        return (n.get(key & 255, 0) + self.mass * self.p(key, level - 1)) / (sum(n.values()) + self.mass)


def test_tree_is_a_distribution():
    text = "abracadabra abracadabra alakazam\n"
    pack = lambda c: sum(ord(x) << 8 * b for b, x in enumerate(reversed(c)))
    seen = [pack(text[i - 6 : i + 1]) for i in range(6, len(text))]
    tree = PlainTree(seen, S.DEPTH)
    for context in ("abraca", "dabra ", "zzzzzz", "akazam"):
        keys = [pack(context) << 8 | x for x in range(256)]
        assert abs(sum(tree.p(k) for k in keys) - 1) < 1e-9
        every = np.array(seen + keys, np.uint64)
        n = np.array([1] * len(seen) + [0] * 256)
        low = S.Low(every & np.uint64(0xFFFFFF), n)
        batch = S._lot(every, n, low, S.GAIN, S.MASS)
        got = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        assert max(abs(10 ** got[k] - tree.p(k)) for k in keys + seen) < 1e-9


def test_symbols_spell_the_words():
    import pyarrow as pa

    from wadi.llm.textcore import Words

    sym, offs = S.symbols(Words(pa.array(["A b  c", None, "xyz"])))
    lead = "\n" * S.DEPTH
    assert [bytes(sym[a:b]).decode() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [f"{lead}a b c\n", f"{lead}\n", f"{lead}xyz\n"]
    assert len(S.grams(sym, offs)) == 6 + 1 + 4


def test_no_context_is_dropped_and_runs_beyond_the_cache_score_alike(docs):
    rng = random.Random(5)
    rows = [None, ""] + [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    table = docs(rows)
    import pyarrow as pa

    from wadi.llm.textcore import Words

    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))]
    sym, offs = S.symbols(Words(pa.array(rows)))
    of = np.repeat(np.arange(len(rows)), np.diff(offs) - S.DEPTH)
    keys = S.grams(sym, offs)
    tree = PlainTree(keys[~np.array(held)[of]].tolist(), S.DEPTH)
    logs = [math.log10(tree.p(k)) for k in keys.tolist()]
    exact = np.bincount(of, weights=logs)
    for cached in (S.RUNS, 50, 0):
        got = {r["doc_id"]: r["score"] for r in S.score(table, cached=cached).collect()}
        assert max(abs(got[i] - exact[i]) for i in range(len(rows))) < 1e-6
    assert S.score(docs([])).count() == 0


def test_known_runs_against_plain_sums():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 600)  # more documents than one sort takes
    runs = rng.integers(0, 40, sizes.sum()).astype(np.uint64) << np.uint64(48)
    table = np.arange(0, 40, 3).astype(np.uint64) << np.uint64(48)
    for keys, logs in ((table, -rng.random(len(table))), (table[:0], np.zeros(0))):
        sums, far, times, cuts = S._known_runs(runs, sizes, keys, logs)
        of = dict(zip(keys.tolist(), logs, strict=True))
        at = 0
        for d, size in enumerate(sizes):
            own = runs[at : at + size].tolist()
            at += size
            assert sums[d] == pytest.approx(sum(of.get(r, 0.0) for r in own))
            want = {r: own.count(r) for r in own if r not in of}
            assert dict(zip(far[cuts[d] : cuts[d + 1]].tolist(), times[cuts[d] : cuts[d + 1]].tolist(), strict=True)) == want
