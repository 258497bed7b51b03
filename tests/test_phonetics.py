"""Phonetic rewrite rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from wadi.functions import phonetics as P


@pytest.mark.parametrize("group, text, expected", [
    ("initial_sukun", "بْن", "بِن"), ("alif_maksora", "هُدَى", "هُدَا"), ("hamza", "أإؤئ", "ءءءء"), ("kashida", "مـن", "من"),
    ("mid_wasl", "ٱلٱسم", "ٱلسم"), ("round_zero", "قالوا۟", "قالو"), ("waw_alif", "صلوٰة", "صلاة"), ("small_letters", "لَهُۥ", "لَهُ"),
    ("word_end", "كتابِ", "كتاب"), ("taa_marboota", "رحمة رحمة", "رحمت رحمه"), ("madd_iwad", "\u0643\u062a\u0627\u0628\u064b\u0627", "\u0643\u062a\u0627\u0628\u064e\u0627"), ("long_zero", "أنا۠ من", "أن من"),
    ("divine_name", P.LAM * 2 + P.SHADDA + P.FATHA + P.HAA + " ", P.LAM * 2 + P.SHADDA + P.FATHA + P.ALIF + P.HAA + " "), ("nasal_merging", "منۢ بعد", "مم بعد"), ("initial_shadda", "مّن", "من"), ("doubled", "ربّ قدْ", "ربب قد"),
    ("yaa_of_verbs", "يُحْيِ", "يُحْيِي"), ("double_sukun", "مِنْ لّ", "مِنِ لّ"), ("echo", "قدْ", "قدْڇ"),
])
def test_each_group(spark, group, text, expected):
    assert spark.range(1).select(P.phonetic(F.lit(text), (group,))).first()[0] == expected


def test_chain_against_plain_regular_expressions(spark):
    """Whole chain, on random texts over all letters and signs of the rules; empty, long and null texts too."""
    draw = random.Random(3)
    signs = sorted({c for rows in P.RULES.values() for row in rows for c in "".join(row) if unicodedata.bidirectional(c) in ("AL", "NSM")})
    texts = ["".join(draw.choice(signs + [" "] * 6) for _ in range(draw.randrange(60))) for _ in range(2000)] + ["", "".join(draw.choice(signs) for _ in range(50_000)), None]

    def plain(text):
        for rows in P.RULES.values():
            for pattern, new in rows:
                text = re.sub(pattern, new, text)
        return text

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.phonetic(F.col("t")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in rows} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("letter, hidden", [("ت", True), ("ظ", True), ("د", True), ("ط", True), ("ة", False), ("ع", False)])
def test_letters_that_hide_a_nasal(spark, letter, hidden):
    """Tanween with the low meem: before taa and thah as before daal, not before taa marboota or ayn."""
    text = f"مًۭ {letter}"
    want = f"مَن {letter}" if hidden else f"مَنْۭ {letter}"
    assert spark.range(1).select(P.phonetic(F.lit(text), ("nasal_merging",))).first()[0] == want


A, I, U_ = P.FATHA, P.KASRA, P.DAMMA
BASE = {"separated": 4, "joined": 5, "joined_pause": 4, "pause": 4, "soft": 4, "letter_name": 6, "linked_meem": 6, "hidden_meem": "ikhfaa"}


def lengthen(spark, rows, options, groups=tuple(P.LENGTHS)):
    texts = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(rows)], "i int, reader int, t string, separated string")
    table = spark.createDataFrame([tuple([k, *[o.get(n) for n in BASE]]) for k, o in options.items()], "reader int, separated int, joined int, joined_pause int, pause int, soft int, letter_name int, linked_meem int, hidden_meem string")
    got = P.with_options(texts, table, "reader").select("i", P.lengthened(F.col("t"), F.col("options"), groups).alias("p")).collect()
    return [r["p"] for r in sorted(got, key=lambda r: r["i"])]


def test_lengths_by_hand(spark):
    cases = [
        ("من بعد", "من بعد"), ("مب", P.HIDDEN_MEEM * 3 + "ب"), ("من يب", "م" + "ي" * 3 + "ب"), ("نت", P.HIDDEN_NOON * 3 + "ت"), (f"ن{P.SHADDA}", "ننن"), (f"ن{P.SHADDA}ا", "نننن" + "ا"),
        (f"ب{A}ا{P.MADD} ء{A}", f"ب{A}" + "ا" * 4 + f" ء{A}"), (f"ب{A}ا{P.MADD}ء{A}", f"ب{A}" + "ا" * 5 + f"ء{A}"), (f"ب{A}ا{P.MADD}ء", f"ب{A}" + "ا" * 4 + "ء"), (f"ب{A}ا{P.MADD}ل{P.SHADDA}", f"ب{A}" + "ا" * 6 + f"ل{P.SHADDA}"),
        (f"ب{U_}ول", f"ب{U_}" + P.SMALL_WAW * 4 + "ل"), (f"خ{A}وف", f"خ{A}" + "و" * 3 + "ف"), (f"ب{I}يب{A}", f"ب{I}" + P.SMALL_YAA_LINK * 2 + f"ب{A}"), (f"ع{A}ي{P.MADD}ن", f"ع{A}" + "ي" * 5 + "ن"),
        (f"م{I}ي{P.MADD}م{A}", f"م{I}" + P.SMALL_YAA_LINK * 6 + f"م{A}"), (f"ا{P.EASING}ب", P.EASED_HAMZA + "ب"), (f"ب{P.LEANING}ا", "ب" + P.LEANING + P.KASHIDA * 2), (f"ي{A}ا{P.MADD}ء{A}ب", f"ي{A}" + "ا" * 4 + f"ء{A}ب"), ("", ""), (None, None),
    ]
    got = lengthen(spark, [(1, t) for t, _ in cases], {1: BASE})
    assert got == [want for _, want in cases]


def test_options_of_each_text(spark):
    text = f"ب{A}ا{P.MADD} ءب{U_}ول"
    got = lengthen(spark, [(1, text), (2, text), (3, text), (4, "مب")], {1: {}, 2: {"separated": 2, "pause": 6}, 4: {"hidden_meem": "meem"}})
    want = lambda apart, end: f"ب{A}" + "ا" * apart + f" ءب{U_}" + P.SMALL_WAW * end + "ل"
    assert got == [want(4, 4), want(2, 6), want(4, 4), "مممب"]
    assert lengthen(spark, [(1, f"خ{A}وف")], {1: {"pause": 2}}) == [f"خ{A}وف"]  # soft is that of the pause
    for wrong in ({"pause": 2, "soft": 4}, {"joined": 7}):
        with pytest.raises(Exception, match="beats must be"):
            lengthen(spark, [(1, "x")], {1: wrong})


def test_lengths_against_plain_regular_expressions(spark):
    draw = random.Random(5)
    signs = [P.FATHA, P.DAMMA, P.KASRA, P.SHADDA, P.SUKUN, P.MADD, P.ALIF, P.WAW, P.YAA, P.HAMZA, P.NOON, P.MEEM, P.BAA, P.LEANING, P.EASING, P.PAUSE, "ل", "ف", " ", " "]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(50))) for _ in range(1500)]

    def plain(text):
        o = dict(BASE, letter_name=5, soft=3, joined_pause=4, hidden_meem=P.HIDDEN_MEEM)
        for rows in P.LENGTHS.values():
            for pattern, pieces in rows:
                new = "".join(p if isinstance(p, str) else (o["hidden_meem"] if p[0] == "{hidden_meem}" else p[0]) * (o[p[1]] if isinstance(p[1], str) else p[1]) for p in pieces)
                text = re.sub(pattern, new.replace("$", "\\"), text)
        return text

    assert lengthen(spark, [(1, t) for t in texts], {1: BASE}) == [plain(t) for t in texts]


def test_attributes_by_hand(spark):
    chunks = ["قَ", "اا", "لَ", "قِ", "ط", "رَ", "اا", P.HIDDEN_NOON * 3, "ضِ", "شْ", "مم", "ذَ", "اا"]
    each = spark.range(1).select(F.inline(P.with_neighbours(F.array(*[F.lit(c) for c in chunks]))))
    rows = each.select("chunk", *P.sound_attributes(F.col("chunk"), F.col("before"), F.col("after"))).collect()
    assert [r["weight"] for r in rows] == ["mofakham", "mofakham", "moraqaq", "low_mofakham", "mofakham", "moraqaq", "mofakham", "mofakham", "mofakham", "moraqaq", "moraqaq", "moraqaq", "moraqaq"]
    assert [r["echo"] == "moqalqal" for r in rows] == [False, False, False, False, True] + [False] * 8
    assert rows[0]["stop"] == "shadeed" and rows[2]["stop"] == "between" and rows[11]["stop"] == "rikhw" and rows[8]["stretch"] == "mostateel" and rows[8]["cover"] == "motbaq"
    assert rows[9]["spread"] == "motafashie" and rows[9]["breath"] == "hams" and rows[5]["repeat"] == "mokarar" and rows[7]["nasal"] == rows[10]["nasal"] == "maghnoon" and rows[0]["whistle"] == "no_safeer"
    assert spark.range(1).select(F.size(P.with_neighbours(F.array().cast("array<string>")))).first()[0] == 0


@pytest.mark.parametrize("chunks, values, word, expected", [
    ("abcabd", "123456", "ab", "45"), ("abcabd", "123456", "bc", "23"), ("abcabd", "1234", "ab", "4"), ("abcabd", "123456", "xy", "56"), ("abc", "1", "xyz", "1"), ("abc", "123", "", ""), ("", "", "ab", ""), ("ab", "12", "ab", "12"),
])
def test_slices_of_a_word(spark, chunks, values, word, expected):
    array = lambda t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    assert spark.range(1).select(F.array_join(P.last_slice(array(values), array(chunks), array(word)), "")).first()[0] == expected
