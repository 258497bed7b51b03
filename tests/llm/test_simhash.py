import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from wadi.llm import simhash as S

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Least id that each can reach, of {id: fingerprint}, by all pairs."""
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def test_fingerprints_against_plain_counting():
    rng = random.Random(4)
    alphabet = ["ab", "Cd", "é", "日本", " ", "  ", "\n", "\t", "\x0b", "\x00", "É", " ", " x "]
    for t in [None, "", " \n", "one", "A b", "a b c", "a b c d", "a b a b a b a b"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]:
        assert S.fingerprint(t) == brute_fingerprint(t)


def test_any_four_positions_contain_a_set():
    for width, n in ((2, 7), (3, 20), (4, 70)):
        assert len(set(S.POSITIONS[width])) == n
        for four in combinations(range(8), 4):
            assert any(set(s) <= set(four) for s in S.POSITIONS[width])


def family(rng, n, base, flips):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)]


def fixture(rng):
    """Chains, a dense ball, a wide ball, lone fingerprints, zero and all ones."""
    fps = [0, 1, (1 << 64) - 1, rng.getrandbits(64)]
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])))
    return fps + family(rng, 150, rng.getrandbits(64), 3) + family(rng, 150, rng.getrandbits(64), 9) + [rng.getrandbits(64) for _ in range(100)]


@pytest.mark.parametrize("width, small", [(2, 4096), (3, 4096), (4, 4096), (2, 16)])
def test_links_join_what_all_pairs_join(spark, width, small):
    fps = sorted(set(fixture(random.Random(width * 100 + small))))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), width, small).collect()
    at = {x: i for i, x in enumerate(signed)}
    want = brute_components(dict(enumerate(fps)))
    parent = list(range(len(fps)))
    for r in found:
        a, b = at[r["a"]], at[r["b"]]
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert {i: root(i) for i in range(len(fps))} == want


def test_documents_against_all_pairs(spark, docs):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [None, "", " ", "x", "X"]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(" ".join(other))
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    want = brute_components({i: brute_fingerprint(t) for i, t in zip(ids, rows, strict=True)})
    got = S.near_duplicates(docs(rows, ids)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


def test_repeated_null_and_no_ids(docs):
    a, b = "one two three four five", "six seven eight nine ten"
    got = S.near_duplicates(docs([a, b, a, b, "lone"], [5, 5, 9, 7, None])).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by == {5: {5}, 9: {5}, 7: {5}, None: {None}} and len(got) == 5
    assert S.near_duplicates(docs([])).count() == 0


def test_long_text_counts_in_steps(monkeypatch):
    text = " ".join(str(i % 977) for i in range(3000))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "STEP", 100)
    assert S.fingerprint(text) == want == brute_fingerprint(text)
