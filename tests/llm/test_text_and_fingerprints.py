import random
import re

import numpy as np
import pyarrow as pa

from wadi.llm import textcore as C
from wadi.llm import winnowing as W

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))


def brute_shingles(text, k=5):
    w = brute_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def texts(n=60):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "日", " ", "  ", "\n", "\t", "\x0b", "\x00", ".", " ", "zz"]
    return [None, "", " \n", "one"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_words_and_shingles_against_brute_force():
    rows = texts()
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])
    seen = {}
    at = 0
    for part in C.chunks([batch], "text", 64):
        words = C.Words(part.column(0))
        values, offs = C.shingles(words)
        for d in range(part.num_rows):
            want = brute_words(rows[at])
            assert [words.text(i) for i in range(words.of[d], words.of[d + 1])] == want
            for i, w in enumerate(want):
                assert seen.setdefault(w, words.hashes[words.of[d] + i]) == words.hashes[words.of[d] + i]
            assert offs[d + 1] - offs[d] == len(brute_shingles(rows[at]))
            at += 1
    assert at == len(rows)
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_read_right():
    col = pa.array(["x y", None, "a b c", "d"]).slice(2)
    w = C.Words(col)
    assert w.of.tolist() == [0, 3, 4]


def test_winnowing_guarantee_and_ties():
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdef ") for _ in range(W.WINDOW + W.K - 1))
    for _ in range(20):
        a = "".join(rng.choice("ghijkl ") for _ in range(200)) + shared + "qqq"
        b = "zz" + shared + "".join(rng.choice("mnopq ") for _ in range(150))
        assert set(W.fingerprint(a)[0]) & set(W.fingerprint(b)[0])
    h, p = W.fingerprint("a" * 100)
    assert len(set(h)) == 1 and p[0] == W.WINDOW - 1  # the rightmost of equal minima
    assert len(W.fingerprint("")[0]) == 0 and len(W.fingerprint("ab")[0]) == 1


def test_winnowing_against_plain_windows():
    text = "the quick brown fox jumps over the lazy dog and runs away from it all"
    h, p = W.fingerprint(text, 4, 5)
    grams = [W.fingerprint(text[i : i + 4], 4, 1)[0][0] for i in range(len(text) - 3)]
    want = []
    for i in range(len(grams) - 4):
        low = min(grams[i : i + 5])
        at = i + max(j for j in range(5) if grams[i + j] == low)
        if not want or want[-1] != at:
            want.append(at)
    assert p.tolist() == want


def test_report_follows_ids(docs):
    rows = {7: "some text of a document " * 9, 3: None, 5: "ab", 11: "another text of a document " * 4, 12: "another text of a document " * 4}
    got = {r["doc_id"]: r for r in W.neighbours_report(docs(list(rows.values()), list(rows))).collect()}
    assert set(got) == set(rows)
    order = sorted(rows)
    import hashlib

    for a, b in zip(order, order[1:] + order[:1], strict=True):
        x, y = rows[a] or "", rows[b] or ""
        q = len(x) // 4
        assert got[a]["edited_sha256"] == hashlib.sha256((x[: len(x) - q] + y[:q]).encode()).hexdigest()
    assert got[11]["fingerprint"] == got[12]["fingerprint"] and got[11]["near_next"] == 1.0
    assert got[3]["fingerprint"] == "" and 0 <= got[7]["near_edited"] <= 1
    assert len(W.decode(got[7]["fingerprint"])) == got[7]["n_hashes"]


def test_report_over_many_parts_and_empty(docs):
    rows = docs([f"text number {i} " * 5 for i in range(40)], [i * 3 for i in range(40)])
    assert W.in_order(rows, 7).where("ahead = 1").count() > 1
    assert W.neighbours_report(rows).count() == 40
    assert W.neighbours_report(docs([])).count() == 0


def test_likeness():
    a, b = np.array([1, 2, 3]), np.array([2, 3, 4])
    assert W.likeness(a, b) == 0.5 and W.likeness(a[:0], b[:0]) == 1 and W.likeness(a, b[:0]) == 0
