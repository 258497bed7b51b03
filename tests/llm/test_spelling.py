import random
import re
import zlib
from collections import Counter

import pytest

from wadi.llm import spelling as S
from wadi.llm.automata import Automaton

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        form = others[0] if others and -others[0][0] >= 10 * n else None
        out[w] = (n, len(others), form and form[1], form and -form[0])
    for w in out:
        last = w
        while out[last][2] is not None:
            last = out[last][2]
        out[w] += (last,)
    return out


def rows_of(got):
    rows = got.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(rng, n=300):
    stems = ["".join(rng.choice("abcdeéÿß") for _ in range(rng.randint(7, 11))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "shorts only, here; 123 日本語"), (None, "nullids nullids")]
    for i in range(n):
        words = [rng.choice(stems[: rng.randint(1, 25)]) for _ in range(rng.randint(5, 60))]
        for k in range(len(words)):
            if rng.random() < 0.05:
                w, at = words[k], rng.randrange(len(words[k]))
                words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "a" + w[at + 1 :]])
        rows.append((10 + i, rng.choice([" ", ", ", "\n", "9", "日"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows


@pytest.mark.parametrize("small", [S.SMALL, 60])
def test_against_all_pairs(docs, small):
    rows = corpus(random.Random(small))
    want = brute(rows)
    assert sum(v[2] is not None for v in want.values()) > 5
    assert rows_of(S.variants(docs([t for _, t in rows], [i for i, _ in rows]), small=small)) == want


def test_chain_of_forms_and_ties(docs):
    words = {"abcdefg": 300, "abcdefx": 30, "abcdeyx": 3, "zabcdef": 2, "abcdefh": 2, "abcdefgh": 20, "abcdefghi": 2}
    rows = [(None, " ".join(w for w, n in words.items() for _ in range(n)))]
    got = rows_of(S.variants(docs([rows[0][1]], [None]), every=10**12))
    assert got["abcdeyx"] == (3, 1, "abcdefx", 30, "abcdefg") and got["abcdefghi"][2:] == ("abcdefgh", 20, "abcdefg")
    assert got["abcdefh"][1] == 3 and got["zabcdef"] == (2, 0, None, None, "zabcdef")
    tied = rows_of(S.variants(docs(["xbcdefg " * 20 + "bbcdefg " * 20 + "abcdefg " * 2]), every=10**12))
    assert tied["abcdefg"][2] == "bbcdefg" and tied["bbcdefg"][1:3] == (2, None)


def test_word_numbers_are_places_and_states_are_least():
    words = sorted({"".join(p).encode() for p in __import__("itertools").product("ab", "cd", "", "efg", ["s", ""])} | {b"x"})
    a = Automaton(words)
    for n, w in enumerate(words):
        state, number = a.root, 0
        for c in w:
            there, arc = a.step(__import__("numpy").array([state]), __import__("numpy").array([c]))
            assert there[0]
            state, number = int(a.to[arc[0]]), number + int(a.skip[arc[0]])
        assert a.end[state] and number == n
    rights = set()
    for w in [b"", *words]:
        for k in range(len(w) + 1):
            rights.add(frozenset(v[k:] for v in words if v[:k] == w[:k]))
    assert len(a.end) == len(rights)


def test_empty_and_long(docs):
    assert S.variants(docs([])).count() == 0 and S.variants(docs([None, "", "a b"])).count() == 0
    run = "a" * 3000
    got = rows_of(S.variants(docs([f"{run} {run} {run}b {run}b"] * 2), every=10**12))
    assert {len(w): v[1] for w, v in got.items()} == {3000: 1, 3001: 1}
