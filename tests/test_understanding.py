import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from wadi.operators import adjust as A
from wadi.operators import dense
from wadi.operators import shaping as S
from wadi.operators import understanding as U


def test_query_types_follow_the_order_of_rules(spark):
    s = U.Signals(fragments=("الله نور",), comparative_strong=("difference between",), comparative_weak=("both", "versus"), definitional_second=("what is",), definitional_strong=("what is",), legal=("ruling",), narrative=("story",), historical=("battle",), story_frames=("tell",), prayer_times=("fajr",), questions=("هل",), connectors=("او",), ambiguous=("صبر جميل",))
    rows = [("الله نُور السماوات", "arabic", "named_concept"), ("The difference between a ruling and b", "english", "comparative"), ("both", "english", "thematic"), ("what is the ruling", "english", "fiqh"), ("What is patience", "english", "definitional"), ("story of the battle", "english", "thematic"), ("tell the story of the battle", "english", "narrative"), ("fajr", "english", "thematic"), ("الصبر", "arabic", "arabic_keyword"), ("هل الصبر", "arabic", "thematic"), ("صبر وشكر", "arabic", "thematic"), ("", "english", "thematic"), (None, "arabic", "arabic_keyword")]
    got = spark.createDataFrame(rows, "q string, l string, want string").select("q", "want", U.query_type(F.col("q"), F.col("l"), s).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_stem_caps_and_floor(spark):
    rows = [(1, i, "a", True, i == 9) for i in range(12)] + [(1, 20, None, True, False), (1, 21, None, False, False)]
    kept = A.stem_caps(spark.createDataFrame(rows, "query_id int, place int, stem string, single boolean, anchored boolean"), F.lit(3), F.lit(4)).collect()
    assert sorted(r["place"] for r in kept) == [0, 1, 2, 9, 21]
    c = spark.createDataFrame([("thematic", None, 1, 0.0), ("fiqh", None, 1, 0.0), ("thematic", 3, 1, 0.0), ("thematic", None, 11, 0.0)], "query_type string, dense_rank int, bm25_rank int, score double")
    assert [round(r["score"], 9) for r in A.lexical_floor(c, F.lit(0.9)).collect()] == [0.006, 0.0, 0.0, 0.0]


def test_spans_batches_and_runs(spark):
    t = spark.createDataFrame([("  ab c",), ("",), ("x\ny ",)], "t string").select(S.word_spans(F.col("t")).alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] for r in t] == [[("ab", 2, 4), ("c", 5, 6)], [], [("x", 0, 1), ("y", 2, 3)]]
    b = S.batches(spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 5, 9, 30])], "lot int, id int, n int"), "lot", "n", 20).orderBy("id").collect()
    assert [r["batch"] for r in b] == [0, 0, 1, 2]
    r = spark.createDataFrame([(["a", "b", "b"],), ([],), (["a"],)], "x array<string>").select(S.trailing_run(F.col("x")).alias("n")).collect()
    assert [x["n"] for x in r] == [2, 0, 1]


def test_blocks_of_queries_find_what_one_batch_finds(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, v array<double>")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, dense.similarities(q, v).collect()))
    monkeypatch.setattr(dense, "QUERY_LIMIT", 4)
    assert sorted(map(tuple, dense.similarities(q, v).collect())) == whole and len(whole) == 15 * 60


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert not set(e.oracle_sql()) - set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
