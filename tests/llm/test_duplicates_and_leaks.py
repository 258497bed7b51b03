import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from tests.llm.test_text_and_fingerprints import brute_shingles
from wadi.llm import chosen_path as P
from wadi.llm import decontaminate as D
from wadi.llm.components import components
from wadi.llm.ids import without_ids
from wadi.llm.textcore import NON_ALNUM, Words


def brute_components(rows, likeness=0.85):
    ids = sorted(rows)
    sets = {i: brute_shingles(rows[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 100 * likeness * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in ids}


def corpus(rng, groups=6, size=12):
    rows, n = {}, 0
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            rows[n] = " ".join(w)
            n += 1
    rows |= {n: None, n + 1: "", n + 2: "too short", n + 3: "Too  SHORT", n + 4: "x " * 3000}
    return rows


def check(docs, rows, **settings):
    got = P.near_duplicates(docs(list(rows.values()), list(rows)), **settings).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
        assert r["n_shingles"] == len(brute_shingles(rows[r["doc_id"]]))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_against_brute_force(docs):
    check(docs, corpus(random.Random(11)))


def test_small_nodes_force_branching_and_blocks(docs):
    check(docs, corpus(random.Random(12), 2, 40), small=8, depth=3)


def test_near_duplicates_edges(docs):
    assert P.near_duplicates(docs([])).count() == 0
    long = " ".join(f"w{i}" for i in range(50))
    got = P.near_duplicates(docs([long, long, "q r s", long], [4, 4, None, 9])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(4, 4, True), (4, 4, True), (9, 4, False)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_likeness_is_inclusive():
    # 17 of 20: exactly 0.85
    a, b = np.append(np.arange(1, 18), 99).astype(np.uint64), np.arange(1, 20, dtype=np.uint64)
    assert P.forest([1, 2], [a, b], Fraction(17, 20)) == [(1, 2)] and P.like(a, b, Fraction(17, 20))
    assert P.forest([1, 2], [a, b], Fraction(18, 20)) == [] and not P.like(a, b, Fraction(18, 20))


def test_links_near_the_threshold_are_found(docs):
    """A thousand pairs of likeness 0.85 to 0.9, in nodes that must branch: nine tenths and more of the links are kept."""
    rng, rows, n = random.Random(3), {}, 0
    common = [f"c{i}" for i in range(12)]
    while n < 2000:
        base = common + [f"w{n}x{i}" for i in range(rng.randint(120, 160))]
        copy = list(base)
        for at in rng.sample(range(20, len(base), 6), 2):
            copy[at] = "edit"
        a, b = brute_shingles(" ".join(base)), brute_shingles(" ".join(copy))
        if 0.85 <= len(a & b) / len(a | b) <= 0.9:
            rows[n], rows[n + 1] = " ".join(base), " ".join(copy)
            n += 2
    got = {r["doc_id"]: r["component_id"] for r in P.near_duplicates(docs(list(rows.values()), list(rows)), small=64).collect()}
    found = sum(got[i + 1] == i for i in range(0, n, 2))
    assert found >= 0.99 * n / 2 and all(got[i] == i for i in range(0, n, 2))


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(3000), 3000)
    chain = [(order[i], order[i + 1]) for i in range(2999)]
    got = dict(components(spark.createDataFrame([*chain, (4000, 5000), (5000, 6000), (5, 5)], "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(3000)) and got[6000] == 4000 and len(got) == 3003
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_ids(docs, spark):
    left = without_ids(docs(list("abcd"), [1, 2, None, 4]), spark.createDataFrame([(2,), (None,), (2,)], "x long"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "4", "None"]
    assert left.columns[:2] == ["doc_id", "text"]


def edit(rng, words, n, pool):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[p] = rng.choice(pool)
        elif kind == 1 and len(words) > 1:
            del words[p]
        else:
            words.insert(p, rng.choice(pool))
    return words


def brute_distance(item, region):
    row = [0] * (len(region) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(region, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))]
        region = [rng.randint(0, 5) for _ in range(rng.randint(1, 20))]
        edits, a, b = D.best_alignment(np.array(item), np.array(region))
        assert edits == brute_distance(item, region)
        if b > a:
            assert edits == brute_distance(item, region[a:b])


def test_leak_recall_against_brute_force():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    raw = [[rng.choice(pool) for _ in range(rng.randint(5, 60))] for _ in range(25)]
    items = D.Items([(i, " ".join(w)) for i, w in enumerate(raw)])
    hit = total = 0
    for _ in range(120):
        i = rng.randrange(len(raw))
        n = len(raw[i])
        doc = [rng.choice(pool) for _ in range(80)] + edit(rng, raw[i], rng.randint(0, int(0.2 * n)), pool) + [rng.choice(pool) for _ in range(80)]
        h = Words(pa.array([" ".join(doc)]), NON_ALNUM).hashes
        if D.best_alignment(items.words[i], h)[0] <= items.slack_of[i]:
            total += 1
            hit += any(x[1] == i for x in D.leaks_in(h, np.array([0, len(h)]), items))
    assert total > 100 and hit >= 0.99 * total


def test_leaks_query(docs, spark):
    item = "The quick, brown fox jumps over the lazy dog and then goes home again tonight"
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "two words")], "item_id long, text string")
    rows = ["before " * 30 + item.upper() + " after" * 9, "clean text only " * 40, None, "", "with Two words inside", item.replace("lazy", "very")]
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.leaks(docs(rows), bench).collect()}
    assert got == {(0, 1, 0), (4, 4, 0), (5, 1, 1)}
    assert D.leaks(docs([]), bench).count() == 0
    assert D.leaks(docs(rows), bench.where("item_id = 9")).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), bench, item_slice=1).collect()} == {(0, 1), (4, 4), (5, 1)}


def test_pipeline_links_pairs_from_four_fifths_on(docs, spark):
    import corpus_pipeline

    rows, pairs = {}, []
    for i, m in enumerate([*range(40, 62)] * 3):
        words = [f"w{i}x{j}" for j in range(m + 4)]
        rows[2 * i], words[m // 2] = " ".join(words), "edit"
        rows[2 * i + 1] = " ".join(words)
        pairs.append((m - 5) / (m + 5))
    assert sum(0.8 <= p < 0.85 for p in pairs) >= 45 and min(pairs) < 0.8
    want = brute_components(rows, 0.8)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(list(rows.values()), list(rows)), "").collect()}
    assert got == {i for i in rows if want[i] == i}
