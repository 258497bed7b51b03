import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wadi.functions import arabic as A
from wadi.functions import text as T
from wadi.functions import vectors as V
from wadi.operators import fusion, pairs
from wadi.operators import sequences as S
from wadi.operators import windows as W
from wadi.sources import tables
from wadi.streaming.gate import Gate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ctc_cases():
    p = np.array([[0.6, 0.4, 0.0]] * 2)
    assert S.ctc_greedy(p) == []
    best = S.ctc_beam(p, n=4)
    assert best[0][0] == (1,) and abs(math.exp(best[0][1]) - 0.64) < 1e-9
    assert [b for _, b in best] == sorted((b for _, b in best), reverse=True)
    path = S.forced_align(np.array([[0.1, 0.8, 0.1], [0.5, 0.3, 0.2], [0.1, 0.1, 0.8]]), [1, 2])
    assert S.collapse(path) == [1, 2]
    assert S.forced_align(np.array([[1.0, 0.0]]), [1, 1]) is None
    assert [k for k, *_ in S.ctc_greedy(np.eye(3)[[1, 1, 0, 2]])] == [1, 2]


def test_edit_rates_and_alignment():
    assert S.chunk_error_rate(["x", "اااا"], ["x", "اا"]) == (0.25, 0.5)
    assert S.chunk_error_rate([], []) == (0.0, 0.0) and S.chunk_error_rate([], ["a"]) == (1.0, 1.0)
    assert S.segment_tags(list("abc"), list("abc")) == ["exact"] * 3
    assert S.segment_tags(list("abc"), list("axc")) == ["exact", "partial", "exact"]
    assert S.segment_tags(list("ab"), []) == ["deleted"] * 2 and S.segment_tags([], list("a")) == ["inserted"]
    ref, hyp = [{"group": "a", "x": "1", "y": None}], [{"group": "a", "x": "2", "y": "3"}]
    assert S.attribute_diffs(ref, hyp) == [(0, "x", "1", "2")] and S.attribute_diffs(ref, []) == []
    assert S.matching_blocks("abxcd", "abcd") == [(0, 0, 2), (3, 2, 2)]
    assert S.seam([1, 2, 3], [2, 3, 4]) == [4] and S.seam([], [1]) == [1]
    assert S.frames_of(16000) == 49 and S.frames_of(10) == 0
    assert S.rerank(["abd", "abc"], "abc") == "abc"


def test_stems():
    assert A.light_stem("الكتاب") == "كتاب" and A.light_stem("رمضان") == "رمضان" and A.light_stem("فرضه") == "فرض"
    assert A.normalize("أَحْمَد") == "احمد"


def test_text_columns(spark):
    lit = F.lit
    assert one(spark, T.chapter_band(lit("N/A"), lit("137"))) == "band100"
    assert one(spark, T.chapter_band(lit("N/A"), lit("x"))) == "band0"
    assert one(spark, T.language_class(lit("ابتثجح"), )) == "arabic"
    assert [one(spark, T.language_class(lit("ا" * n + "x" * (10 - n)))) for n in (6, 3, 2)] == ["arabic", "mixed", "english"]
    arr = lambda s: F.array(*[lit(c) for c in s])
    assert one(spark, T.duplicate_sets(arr("abcd"), arr("abcxyz")))
    assert [one(spark, T.status_of(lit(x))) for x in (0.05, 0.5, 0.75)] == ["correct", "errors", "locked"]
    assert one(spark, V.argmax(F.array(lit(0.1), lit(0.9)))) == 1
    assert one(spark, T.fuzzy_score(lit("ab"), lit("zzz"))) == 0.0


def test_sliding_passages(spark):
    rows = spark.createDataFrame([("g", i) for i in range(7)] + [("h", 0), ("h", 1)], "g string, o int")
    got = sorted((r["size"], r["start"], r["n"]) for r in W.sliding_passages(rows, "g", "o", [(3, 1), (6, 3)], ["o"]).collect())
    assert got == [(3, 0, 3), (3, 1, 3), (3, 2, 3), (3, 3, 3), (3, 4, 3), (3, 5, 2), (6, 0, 6), (6, 3, 4)]


def test_fusion_cases(spark):
    c = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2), (1, 3, 0.2, 3), (1, 4, 0.25, 4), (1, 5, 0.01, 5)], "query_id long, doc_id long, score double, rank long")
    kept = c.withColumn("k", fusion.score_floor(F.col("score"), F.col("rank"))).where("k").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2, 3]
    g = spark.createDataFrame([(1, i, g, i) for i, g in enumerate("AAAAB")], "query_id long, doc_id long, g string, rank long")
    assert [r["g"] for r in fusion.cap_defer(g, "g", "rank").orderBy("place").collect()] == list("AAABA")
    d = spark.createDataFrame([(1, 7, 1)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 7, 2)], "query_id long, doc_id long, rank long")
    assert fusion.rrf(d, b, 0.7, 0.3).first()["rrf_score"] == pytest.approx(0.7 / 61 + 0.3 / 62, abs=1e-9)


def test_similar_sets_against_brute_force(spark):
    import random

    rng = random.Random(1)
    sets = {i: {rng.randrange(12) for _ in range(rng.randint(1, 9))} for i in range(40)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, words array<string>")
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r["a"], r["b"]) for r in pairs.similar_sets(df, 0.6).collect()} == want


def test_similar_sets_in_cells_and_blocks(spark, monkeypatch):
    import random

    rng = random.Random(2)
    base = [rng.sample(range(2000), rng.choice([3, 20, 70, 200])) for _ in range(12)]
    sets = {}
    for i in range(150):
        own = rng.choice(base)
        sets[f"s{i}"] = set(rng.sample(own, max(1, int(len(own) * rng.uniform(0.6, 1))))) | set(rng.sample(range(2000), rng.randrange(4)))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.55}
    first = {frozenset(s): i for i, s in sorted(sets.items(), reverse=True)}
    want = {(a, b) for a, b in want if first[frozenset(sets[a])] == a and first[frozenset(sets[b])] == b}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id string, words array<string>")
    monkeypatch.setattr(pairs, "PAIRS", 50)
    for frequent, words in ((1 << 20, 1 << 23), (40, 900)):
        got = pairs.similar_sets(df, 0.55, frequent, words).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 300
        for r in got:
            a, b = sets[r["a"]], sets[r["b"]]
            assert r["jaccard"] == round(len(a & b) / len(a | b), 6)


def test_cells_make_each_pair_once(monkeypatch):
    """A block that meets itself makes a pair once, codes that words of a set share too; cells are counted as they are dealt."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    lists = [sorted(rng.choices(range(30), k=20)) for _ in range(60)]
    rows = pa.table({"side": pa.array([0] * 60, pa.int32()), "n": pa.array([20] * 60), "words": pa.array(lists, pa.list_(pa.int32()))})
    cell = (int(pairs._class(20)) * 64) << 40
    for lot in (40, 1 << 18):
        monkeypatch.setattr(pairs, "LOT", lot)
        got = [p for x, y in pairs._met(cell, rows, 0.3) for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and all(x < y for x, y in got)
        likeness, least, want = 0.3, 1, set()
        beyond = least - int(pairs._need(20, 20, likeness))
        for x in range(60):
            for y in range(x + 1, 60):
                if any(a == b for a in lists[x][: 20 + beyond] for b in lists[y][: 20 + beyond]):
                    want.add((x, y))
        assert set(got) == want
    blocks = np.array([0, 2, 1, 3])
    assert pairs._cells(blocks, 0.9) == (3 + 1 + 6) + (2 * 1 + 1 * 3)


def test_pairs_that_only_share_a_word_do_not_leave_a_task(spark):
    # any two share a rare word early in their order, and are far from alike
    rows = [(i, [f"r{min(i, j)}_{max(i, j)}" for j in range(40)] + [f"o{i}_{j}" for j in range(60)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    seen = []
    whole = pairs._compared
    try:
        pairs._compared = lambda near, sets, kind: seen.append(near.count()) or whole(near, sets, kind)
        assert pairs.similar_sets(df, 0.55).count() == 0
    finally:
        pairs._compared = whole
    assert seen == [0]


def test_every_copy_has_the_class_of_its_set(spark):
    import duckdb
    import pandas as pd

    from wadi.plans import lookup

    rows = [(3, "one two three"), (1, "three ONE two two"), (2, "one two"), (9, "one, two, three"), (4, None), (5, "a b"), (6, "four five six")]
    got = pairs.set_classes(spark.createDataFrame(rows, "id long, text string").select("id", T.tokens(F.col("text")).alias("words")))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841 (read by the SQL)
    want = {3: 1, 1: 1, 2: 2, 9: 1, 4: None, 5: None, 6: 6}
    assert {r["id"]: r["class_id"] for r in got.collect()} == want == dict(duckdb.sql(lookup.SQL["near_dup_classes"]).fetchall())


def test_error_rate_of_whole_turns(spark, tmp_path):
    import random

    from wadi.plans.sequences import align_error_rate

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice(["abc", "aabc", "cab", "abcabca", "x", "y", "zz"]) for _ in range(rng.randint(n, 12))] for n in (1, 0))
        assert S.word_edits(a, b) == S.edit_table(a, b, S.substitution_cost)[-1, -1]
    words = [f"word{i}" for i in range(90)]
    later = [*words[:60], "other", *words[61:], "more"]
    spark.createDataFrame([(1, 0, " ".join(words)), (1, 1, " ".join(later))], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = align_error_rate(spark, str(tmp_path)).collect()
    assert [(r["edits"], r["rate"]) for r in got] == [(2.0, round(2 / 90, 6))]


def test_gate():
    g = Gate()
    assert [e for p in (0.9, 0.9, 0.1, 0.1, 0.1, 0.1, 0.9) if (e := g.step(p))] == ["speech_start", "phrase_boundary"]
    h = Gate(floor=0.2)
    assert [e for p in (0.9, 0.9) if (e := h.step(p))] == ["speech_start"]
    assert not any(h.step(0.1, 0.5) for _ in range(5))


def test_audio():
    import struct

    pcm = struct.pack("<4h", 0, 16384, -32768, 32767)
    wav = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    assert tables.decode_wav(wav).tolist()[:3] == [0.0, 0.5, -1.0] and len(tables.decode_wav(b"no")) == 0
    d = tables.PcmDecoder()
    assert len(d.feed(pcm[:3])) == 1 and len(d.feed(pcm[3:])) == 3


def test_runs_over_blocks_against_a_plain_loop(spark):
    import itertools
    import random

    rng = random.Random(5)
    rows = [(g, i, rng.choice([0, 0, 1, None])) for g in ("a", "b", None) for i in rng.sample(range(200), 90)]
    rows += [("long", i, 7) for i in range(0, 100, 3)]
    want = set()
    for g in ("a", "b", None, "long"):
        for n, (v, run) in enumerate(itertools.groupby(sorted((i, v) for h, i, v in rows if h == g), key=lambda r: r[1]), 1):
            run = [i for i, _ in run]
            want.add((g, n, v, run[0], run[-1], len(run)))
    for block in (10, 64, 1 << 16):
        got = W.runs(spark.createDataFrame(rows, "g string, at long, v long"), "g", "at", "v", block)
        assert {tuple(r) for r in got.collect()} == want


def test_upserts_survive_a_restart_and_a_replay(spark, tmp_path):
    from wadi.streaming.windows import UpsertSink

    def batch(*rows):
        return spark.createDataFrame(rows, "k long, day string, at long, v string")

    def now():
        sink = UpsertSink(str(tmp_path), ["k", "day"], "at")
        return {(r["k"], r["day"]): r["v"] for r in sink.table(spark, batch((1, "", 1, "")).schema).collect()}

    assert now() == {}
    UpsertSink(str(tmp_path), ["k", "day"], "at")(batch((1, "m", 1, "a"), (2, "m", 1, "b"), (1, None, 1, "n")), 0)
    UpsertSink(str(tmp_path), ["k", "day"], "at")(batch((1, "m", 3, "c"), (1, "m", 2, "late"), (3, "t", 1, "d")), 1)
    want = {(1, "m"): "c", (2, "m"): "b", (3, "t"): "d", (1, None): "n"}
    assert now() == want
    UpsertSink(str(tmp_path), ["k", "day"], "at")(batch((1, "m", 3, "c"), (1, "m", 2, "late"), (3, "t", 1, "d")), 1)
    assert now() == want
    UpsertSink(str(tmp_path), ["k", "day"], "at")(batch((1, "m", 2, "old"), (2, "m", 1, "same")), 2)
    assert now() == want | {(2, "m"): "same"}


def test_resumable_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = []

    def double(df):
        seen.append(df.count())
        return df.withColumn("y", F.col("x") * 2)

    tables.write_resumable(spark.createDataFrame([(1,), (2,)], "x long"), path, "x", double)
    got = tables.write_resumable(spark.createDataFrame([(2,), (3,)], "x long"), path, "x", double)
    assert seen == [2, 1] and sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 4), (3, 6)]


def test_best_start_keeps_the_earliest_of_equals():
    from wadi.operators.sequences import best_start

    assert best_start(["ab", "cd", "ab", "xy"], "ab", 3) == (0, 0.0)
    assert best_start(["ab", "cd"], "cd", 1) == (1, 0.0)


def test_few_edits_are_word_edits():
    import random

    from wadi.operators.sequences import few_edits, word_edits

    rng = random.Random(9)
    for _ in range(300):
        a, b = (["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))] for _ in "xy")
        assert few_edits(a, b) == word_edits(a, b)


def test_contained_against_brute_force(spark):
    import random

    from wadi.operators import pairs

    rng = random.Random(8)
    draw = lambda n: [rng.choice("abcdefghijklmnop") * 3 for _ in range(n)]
    docs, items = {i: draw(rng.randint(0, 14)) for i in range(80)}, {i: draw(rng.randint(0, 8)) for i in range(40)}
    table = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} int, words array<string>")
    for share in (0.5, 0.75, 1.0):
        want = {(i, d, len(set(w) & set(x)), len(set(w))) for i, w in items.items() for d, x in docs.items() if w and len(set(w) & set(x)) >= share * len(set(w))}
        got = {(r["item"], r["doc"], r["both"], r["n"]) for r in pairs.contained(table(items, "item"), table(docs, "doc"), share).collect()}
        assert got == want
