"""References, routing and reading by key."""

import pytest
from pyspark.sql import functions as F

from wadi.operators import references as R
from wadi.operators import understanding as U

CORPUS = R.Corpus(
    {"bukhari": "eng-bukhari", "muslim": "eng-muslim", "tirmidhi": "eng-tirmidhi", "abudawud": "eng-abudawud", "abu dawud": "eng-abudawud"},
    topics=("verses about", "what does", "آيات"), stories=("story", "قصة"), prayer_times=("fajr time",),
)
NAMES = [
    (1, 1, "al-fatihah", False, False), (1, 2, "الفاتحة", False, False), (2, 3, "al-baqarah", False, False), (2, 4, "البقرة", False, False), (12, 5, "yusuf", True, True), (12, 6, "يوسف", True, True),
    (18, 7, "al-kahf", False, True), (18, 8, "الكهف", False, True), (112, 9, "al-ikhlas", False, False), (112, 10, "الإخلاص", False, False), (19, 11, "maryam", True, True),
]
CASES = {
    "2:255": "Q_2:255", " 2 / 255 ": "Q_2:255", "Surah 2 verse 255": "Q_2:255", "see Q2:255 please": "Q_2:255", "002:005": "Q_2:5", "Bukhari 1": "H_eng-bukhari_1", "hadith muslim 12": "H_eng-muslim_12", "33 abu dawud": "H_eng-abudawud_33",
    "surah 18": "Q_18:1", "chapter 115": None, "سورة 18": "Q_18:1", "al-baqarah 255": "Q_2:255", "ayah 255 of al baqara": "Q_2:255", "al baqarah the long verse 5": "Q_2:5", "الآية 255 من سورة البقرة": "Q_2:255",
    "سورة الفاتحة ": "Q_1:1", "Surah al-Ikhlas": "Q_112:1", "سورة الإخلاص": "Q_112:1", "el-kahf": "Q_18:1", "albaqarah": "Q_2:1", "al ikhlaas": "Q_112:1", "al-kahf surah": "Q_18:1", "verses about al-kahf": None, "story of al-kahf": None,
    "yusuf": None, "surah yusuf": "Q_12:1", "يوسف": None, "سورة يوسف": "Q_12:1", "قصة سورة يوسف": None, "yusuf 4": "Q_12:4", "alkahfi": None, "fajr time 5": None, "fajr time al-baqarah": None, "": None, "garbage zzzz": None, "آيات سورة البقرة": None,
}


@pytest.fixture(scope="module")
def names(spark):
    table = spark.createDataFrame(NAMES, "unit int, place int, name string, needs_unit boolean, story boolean")
    return R.name_table(table).cache()


def test_cases(spark, names, monkeypatch):
    rows = [(i, q) for i, q in enumerate(CASES)] + [(900, None), (0, "2:255")]
    queries = spark.createDataFrame(rows, "id int, query string")
    for limit in (R.BROADCAST_ROWS, 0):
        monkeypatch.setattr(R, "BROADCAST_ROWS", limit)
        got = R.references(queries, names, CORPUS).collect()
        found = {r["id"]: r["chunk_id"] for r in got}
        for i, (q, want) in enumerate(CASES.items()):
            assert found.get(i) == want, q
        assert 900 not in found and sum(r["id"] == 0 for r in got) == 2
    whole = {r["chunk_id"]: (r["whole"], r["items"]) for r in got}
    assert whole["Q_1:1"] == (True, 4) and whole["Q_2:255"] == (False, 1)
    assert R.references(queries.limit(0), names, CORPUS).count() == 0


def test_names_come_before_spellings(names):
    table = {r["spelling"]: r["unit"] for r in names.collect()}
    assert table["al-baqarah"] == 2 and table["el bakarah"] == 2 and table["البقره"] == 2 and table["al-kahf"] == 18 and "kaf" not in table


def test_words_and_concepts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.query_words(F.lit("والصلاة في البيت"), ("وال", "ال", "و"))) == ["والصلاه", "صلاه", "الصلاه", "في", "البيت", "بيت"]
    assert one(R.query_words(F.lit(None).cast("string"), ("ال",))) == []
    meta = ("تعريف", "وشروطها", "ما", "هو", "معنى", "في")
    assert one(R.concept_of(F.lit("تعريف الزكاة وشروطها"), (), meta)) == "الزكاه"
    assert one(R.concept_of(F.lit("معنى التوحيد في القرآن؟"), ("في القرآن الكريم", "في القرآن"), meta)) == "التوحيد"


def test_routing(spark, names):
    s = U.Signals(book=("quran",), reports=("hadith",), dual_source=("quran and hadith",), legal=("ruling",), narrative=("story",), ambiguous=("جهاد",), book_terms=("جنه",), fragments=("احد الصمد",))
    rows = [
        (1, "2:255", None), (2, "2:255", "hadith"), (3, "throne verse", None), (4, "throne verse", "hadith"), (5, "ruling in hadith", None), (6, "ruling in hadith", "hadith"), (7, "quran and hadith on trade", None),
        (8, "جنه", None), (9, "", "quran"), (10, None, None), (11, "a story in the quran", None), (12, "Bukhari 1", "quran"), (13, "احد الصمد", None),
    ]
    queries = spark.createDataFrame(rows, "id int, query string, scope string")
    aliases = spark.createDataFrame([("Throne Verse", "Q_2:255"), ("Throne Verse", "Q_9:9")], "alias string, chunk_id string")
    got = {r["id"]: (r["query_type"], r["scope"], r["early_exit"], r["chunk_id"]) for r in R.route(queries, R.references(queries, names, CORPUS), aliases, s).collect()}
    assert got[1] == ("direct_reference", "all", True, "Q_2:255") and got[2][1:3] == ("hadith", False)
    assert got[3] == ("named_concept", "all", True, "Q_2:255") and got[4][1:3] == ("hadith", False)
    assert got[5][:2] == ("fiqh", "all") and got[6][:2] == ("fiqh", "hadith") and got[7][:2] == ("thematic", "all")
    assert got[8][:2] == ("arabic_keyword", "quran") and got[9] == ("thematic", "quran", False, None) and got[10] == ("thematic", "all", False, None)
    assert got[11][:2] == ("narrative", "quran") and got[12][1:3] == ("quran", False) and got[13][:2] == ("named_concept", "quran") and len(got) == 13


def test_reading_by_key(spark, tmp_path, names):
    path = str(tmp_path / "corpus")
    corpus = spark.range(1, 301).select(F.concat(F.lit("Q_2:"), F.col("id")).alias("chunk_id"), F.col("id").alias("n"), F.lit("x").alias("place_name"))
    R.write_by_key(corpus, path, files=4)
    few = R.read_keys(spark, path, ["Q_2:255"])
    assert [r["n"] for r in few.collect()] == [255]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(chunk_id,Q_2:255)" in plan or "In(chunk_id" in plan
    queries = spark.createDataFrame([(1, "al-baqarah"), (2, "2:7"), (3, "2:999")], "id int, query string")
    got = R.read_references(spark, path, R.references(queries, names, CORPUS)).orderBy("id", "place").collect()
    assert [(r["id"], r["n"]) for r in got] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 7)]
