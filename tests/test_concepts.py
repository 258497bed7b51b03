"""Contrasted concepts, balance, transliterated terms and attribute labels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wadi.operators import concepts as C

FRAME = ("what", "is", "the", "between", "difference", "of")


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize("query, expected", [
    ("What is the difference between prayer and fasting?", ["prayer", "fasting"]),
    ("fasting and charity in the summer", ["fasting in summer", "charity in summer"]),
    ("mercy vs justice in quran", ["mercy", "justice"]),
    ("mercy", ["mercy"]), ("", []), (None, []),
    ("الحلال والحرام في الطعام", ["الحلال في الطعام", "الحرام في الطعام"]),
])
def test_comparative_concepts(spark, query, expected):
    assert one(spark, C.comparative_concepts(F.col("q"), ("difference between",), FRAME), q=query) == expected


def test_split_concepts(spark):
    assert one(spark, C.split_concepts(F.col("q"), ()), q="الصبر والشكر") == ["الصبر", "شكر"]
    assert one(spark, C.split_concepts(F.col("q"), ()), q="الصبر") == []


def test_contrast_query_writes_a_shared_context_once(spark):
    parts = F.array(F.lit("fasting in summer"), F.lit("charity in summer"))
    assert one(spark, C.contrast_query(parts, F.lit(" and ")), q="") == "fasting and charity in summer"
    assert one(spark, C.contrast_query(F.array(F.lit("a in b"), F.lit("c")), F.lit(" and ")), q="") == "a in b and c"


def test_labels_and_keys(spark):
    assert one(spark, C.attribute_label(F.col("h"), F.col("t")), h="qalqla", t="[مقلقل]") == "moqalqal"
    assert one(spark, C.attribute_label(F.col("h"), F.col("t")), h="qalqla", t="moqalqal") == "moqalqal"
    assert one(spark, C.transliteration_key(F.col("q")), q=" Al-Qur’an  Karim ") == "al qur'an karim"
    assert one(spark, C.alias_key(F.col("q")), q=" Al_Baqarah--x ") == "al baqarah x"


def brute_expand(text, lookup, most):
    """Word by word, the longest phrase from each."""
    words, out, cursor, i = list(re.finditer("[A-Za-z][A-Za-z'’`ʿʾ]*", text)), "", 0, 0
    while i < len(words):
        for n in range(min(most, len(words) - i), 0, -1):
            gaps = [text[words[j].end() : words[j + 1].start()] for j in range(i, i + n - 1)]
            key = " ".join(re.sub("['’`ʿʾ]", "'", words[j].group().lower()) for j in range(i, i + n))
            hit = lookup.get(key) or (lookup.get(key[:-1]) if key.endswith("s") and len(key) > 4 else None)
            if hit and all(re.fullmatch(r"[\s\-]+", g) for g in gaps):
                out += text[cursor : words[i].start()] + hit.replace("{match}", text[words[i].start() : words[i + n - 1].end()])
                cursor, i = words[i + n - 1].end(), i + n
                break
        else:
            i += 1
    return out + text[cursor:]


@pytest.mark.parametrize("broadcast_rows", [C.LOOKUP_ROWS, 0])
def test_expand_terms_against_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(C, "LOOKUP_ROWS", broadcast_rows)
    lookup = {"sabr": "الصبر", "battle of badr": "غزوة بدر", "badr": "بدر", "prophet": "{match} (نبي)", "al bakara": "البقرة"}
    draw = random.Random(5)
    parts = ["sabr", "Battle", "of", "badr", "prophets", "al", "Bakara", "x1", "é", "qur’an"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "-", ", ", "  "]) for _ in range(draw.randrange(12))) for _ in range(200)] + ["", None, "sabr", "sabr", "'sabr'", "sabr " * 3000]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, key string")
    table = spark.createDataFrame(list(lookup.items()), "key string, replacement string")
    found = C.expand_terms(rows, "text", table, 3).collect()
    assert len(found) == len(texts) and found[0].asDict().keys() == {"id", "text", "key", "expanded"}
    assert {r["id"]: r["expanded"] for r in found} == {i: None if t is None else brute_expand(t, lookup, 3) for i, t in enumerate(texts)}
    assert C.expand_terms(rows.limit(0), "text", table, 3).count() == 0


def brute_balance(rows, concepts, k, each):
    if len(rows) <= k:
        return rows
    floor, head, tail = rows[0][1] * C.BALANCE_SHARE, rows[:k], rows[k:]
    for c in concepts:
        for _ in range(each):
            shared = lambda x: sum(y[2] == x for y in head)
            goes = [x for x in head if x[2] is None or (x[2] != c and shared(x[2]) > each)]
            comes = [x for x in tail if x[2] == c and x[1] >= floor]
            if shared(c) < each and goes and comes:
                head = [x for x in head if x != goes[-1]] + comes[:1]
                tail = goes[-1:] + [x for x in tail if x != comes[0]]
    return sorted(head, key=lambda x: -x[1]) + tail


def brute_promote(rows, concepts):
    rows = list(rows)
    for c in concepts:
        at = next((i for i, x in enumerate(rows) if x[2] == c), 0)
        if at > 2 and rows[at][1] >= C.SIDE_LEAST:
            rows.insert(2, rows.pop(at))
    return rows


def test_balance_and_promotion_against_brute_force(spark):
    draw = random.Random(9)
    lists = {q: [(q * 100 + i, s, draw.choice([None, "a", "a", "b"])) for i, s in enumerate(sorted((round(draw.random(), 2) for _ in range(draw.randrange(1, 14))), reverse=True))] for q in range(120)}
    rows = spark.createDataFrame([(q, d, i + 1, s, c) for q, xs in lists.items() for i, (d, s, c) in enumerate(xs)], "query_id int, doc_id int, rank int, score double, concept string")

    def order(frame):
        out = {}
        for r in frame.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["doc_id"])
        return out

    assert order(C.balance_concepts(rows, ("a", "b"), 5, 2)) == {q: [x[0] for x in brute_balance(xs, ("a", "b"), 5, 2)] for q, xs in lists.items()}
    assert order(C.balance_concepts(rows, ("a", "b"), 5, 0)) == {q: [x[0] for x in xs] for q, xs in lists.items()}
    assert order(C.promote_each_concept(rows, ("a", "b"))) == {q: [x[0] for x in brute_promote(xs, ("a", "b"))] for q, xs in lists.items()}
