import random

from pyspark.sql import functions as F

from wadi.operators import narrations as N


def plain_start(kinds, gap):
    """Word by word: where the chain ends, or None."""
    if "t" not in kinds[:3]:
        return None
    for i, k in enumerate(kinds):
        last = kinds.rfind("t", 0, i)
        if k == "p":
            return i - 1 if i and kinds[i - 1] in "ts" else last + 1 if last + 1 < i else i
        if k == "s" and last >= 0 and kinds[i + 1 : i + 2] != "t":
            return i
        if last >= 0 and i - last > gap:
            return last + 1
    return kinds.rfind("t") + 1


def test_end_of_chains_against_a_plain_walk(spark):
    rng = random.Random(4)
    cases = sorted({"".join(rng.choices("tspo", (3, 2, 0.2, w), k=rng.randint(0, 40))) for w in (2, 12, 40) for _ in range(700)})
    for gap in (3, 12):
        rows = spark.createDataFrame([(c,) for c in cases], "k string").select("k", N.own_words_start(F.col("k"), gap).alias("s")).collect()
        assert {r["k"]: r["s"] for r in rows} == {c: plain_start(c, gap) for c in cases}


def test_own_text(spark):
    own = "انما الاعمال بالنيات وانما لكل امرئ ما نوى فمن كانت هجرته"
    chain = "حدثنا عبد الله بن يوسف قال أَخْبَرَنَا مالك عن نافع عن ابن عمر"
    filler = "كلمات كثيرة قبل ذلك لا تدل على شيء من الكلام ثم "
    cases = {
        f"{chain} قال {own}": (f"قال {own}", True),
        f"{chain} عن النبي صلى الله عليه وسلم {own}": (f"عن النبي صلى الله عليه وسلم {own}", True),
        f"{filler}قال رسول الله صلى {own}": (f"قال رسول الله صلى {own}", True),
        f'{filler}قال "{own}': (f'قال "{own}', False),
        f"{filler}قال زيد {own}": (f"قال زيد {own}", False),
        filler * 2: ((filler * 2)[int(len(filler * 2) * 0.35) :], False),
        "": ("", False),
        None: (None, False),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.own_text(F.col("t")).alias("o")).collect()
    assert {r["t"]: tuple(r["o"]) for r in rows} == cases


def test_notes_around_a_narration(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]

    body = "كلام طويل من متن الحديث لا ينتهي "
    assert one(N.without_grading, body + "هذا حديث حسن صحيح") == body
    assert one(N.without_grading, "هذا حديث حسن " + body) == "هذا حديث حسن " + body
    assert one(N.without_english_chain, "Narrated Abu Huraira: The deeds are considered by the intentions.") == "The deeds are considered by the intentions."
    assert one(N.without_english_chain, "Narrated Umar: Yes.") == "Narrated Umar: Yes."
    assert one(N.without_citations, "ثم قوله تعالى في سورة البقرة كذا") == "ثم   كذا"
    assert [one(f, None) for f in (N.without_grading, N.without_english_chain, N.without_citations)] == [None] * 3
