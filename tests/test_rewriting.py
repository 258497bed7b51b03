"""Rewriting with maps of code points."""

import random
import re

import numpy as np
import pytest

from wadi.functions import phonetics as P
from wadi.operators import rewriting as R


def rows(image):
    return list(zip(image.start.tolist(), image.end.tolist(), image.deleted.tolist(), strict=True))


@pytest.mark.parametrize("rule, text, new, expected", [
    (("x", ""), "axb", "ab", [(0, 1, False), (1, 1, True), (1, 2, False)]),  # deleted
    (("x", "y"), "axb", "ayb", [(0, 1, False), (1, 2, False), (2, 3, False)]),  # replaced
    (("(a)", r"\1\1\1"), "bac", "baaac", [(0, 1, False), (1, 4, False), (4, 5, False)]),  # a run grows: to the letter before
    (("b", "xyb"), "abc", "axybc", [(0, 1, False), (1, 4, False), (4, 5, False)]),  # put in front: to the letter after
    (("abc", "z"), "abcd", "zd", [(0, 1, False), (1, 1, True), (1, 1, True), (1, 2, False)]),  # letters too many are deleted
    (("a", "xyz"), "ab", "xyzb", [(0, 1, False), (3, 4, False)]),  # new letters too many are a gap
    (("b c", "xyz"), "b c", "xyz", [(0, 2, False), (2, 2, True), (2, 3, False)]),  # a blank gives its place to the letter before
    (("(?=b)", "-"), "abb", "a-b-b", [(0, 1, False), (1, 3, False), (3, 5, False)]),  # no width: put in
    (("$", "!"), "ab", "ab!", [(0, 1, False), (1, 2, False)]),  # at the end: nobody's
    (("a", ""), "aa", "", [(0, 0, True), (0, 0, True)]),
    (("a", "b"), "", "", []),
])
def test_one_rule(rule, text, new, expected):
    result, image = R.rewrite(rule, text)
    assert result == new == re.sub(*rule, text) and rows(image) == expected


def test_pieces_and_script_agree():
    rng = random.Random(4)
    rules = [("a", ""), ("[ab]", "c"), ("(.)(.)", r"\2\1"), ("b+", "xy"), ("(a)b*", r"\1"), ("c.", "z"), (" ", "-"), ("a b", "c")]
    for _ in range(600):
        text, rule = "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 20))), rng.choice(rules)
        (fast, a), (slow, b) = R.rewrite(rule, text), R._rewrite_by_script(rule, text)
        assert fast == slow == re.sub(*rule, text) and rows(a) == rows(b)


def test_hand_made_chain():
    text, image = R.rewrite_all([("-", ""), ("(o)", r"\1\1"), ("t", "")], "b-o-t")
    assert text == "boo" and rows(image) == [(0, 1, False), (1, 1, True), (1, 3, False), (3, 3, True), (3, 3, True)]


def fold(rules, text):
    """The same by lists, one code point after another, without composing maps of rules."""
    at = [(i, i + 1, False) for i in range(len(text))]
    for rule in rules:
        new, image = R.rewrite(rule, text)
        step, moved = rows(image), []
        for a, b, gone in at:
            if gone or not step:
                p = 0 if not step else step[a][0] if a < len(step) else step[-1][1]
                moved.append((p, p, True))
            else:
                moved.append((step[a][0], step[b - 1][1], all(step[i][2] for i in range(a, b))))
        at = [(a, a if gone and all_gone else b, gone) for (a, b, gone), all_gone in zip(moved, [m[2] for m in moved], strict=True)]
        text = new
    return text, at


RULES = [("a", ""), ("(b)", r"\1\1"), ("c ", "d"), ("e", "fa"), ("(.)d", r"\1"), ("f+", "f"), ("b", "ab"), (" ", ""), ("da", "c")]


def test_chains_against_code_points_one_at_a_time():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 25)))
        rules = [rng.choice(RULES) for _ in range(rng.randint(1, 5))]
        want_text, want = fold(rules, text)
        got_text, image = R.rewrite_all(rules, text)
        plain = text
        for rule in rules:
            plain = re.sub(*rule, plain)
        assert got_text == want_text == plain
        assert [(a, b, g) if not g else (a, None, g) for a, b, g in rows(image)] == [(a, b, g) if not g else (a, None, g) for a, b, g in want]


def test_composition_is_associative_without_gaps():
    rng = random.Random(7)
    rules = [("a", ""), ("(b)", r"\1\1"), ("c", "d"), ("f+", "f"), ("ef", "e")]
    for _ in range(300):
        text, steps = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 20))), []
        for rule in rng.choices(rules, k=3):
            text, image = R.rewrite(rule, text)
            steps.append(image)
        a, b, c = steps
        left, right = a.then(b).then(c), a.then(b.then(c))
        for part in ("start", "end", "deleted"):
            assert np.array_equal(getattr(left, part), getattr(right, part))


def test_rules_of_sounds_keep_every_code_point_in_order():
    rng = random.Random(3)
    signs = sorted({c for group in P.RULES.values() for row in group for c in "".join(row) if ord(c) > 0x600})
    rules = [row for group in P.RULES.values() for row in group]
    for _ in range(300):
        text = "".join(rng.choice([*signs, " ", " "]) for _ in range(rng.randint(0, 60)))
        new, image = R.rewrite_all(rules, text)
        plain = text
        for rule in rules:
            plain = re.sub(*rule, plain)
        assert new == plain and len(image.start) == len(text)
        assert (np.diff(image.start) >= 0).all() and (image.end >= image.start).all() and (image.end <= len(new)).all()


def test_table(spark):
    texts = [None, "", "b-o-t", "x" * 50_000 + "-"]
    df = spark.createDataFrame([(i, t, "chars") for i, t in enumerate(texts)], "id int, text string, chars string")
    rules = [("-", ""), ("(o)", r"\1\1")]
    got = {r["id"]: r for r in R.with_map(df, "text", rules, ["id"]).collect()}
    assert got[0]["rewritten"] is None and got[0]["chars"] is None and got[1]["chars"] == [] and got[2]["rewritten"] == "boot"
    assert len(got[3]["chars"]) == 50_001
    n = R.char_rows(R.with_map(df, "text", rules, ["id"]), ["id"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in n} == {2: 5, 3: 50_001}
    assert R.with_map(df.limit(0), "text", rules, ["id"]).count() == 0
