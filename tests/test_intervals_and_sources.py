"""Greedy intervals against plain loops; sources on fixtures."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wadi.operators import intervals as I
from wadi.sources import readers as R
from wadi.sources import tables as T


@pytest.mark.parametrize("redundant", [I.overlapping, I.redundant_passage(), I.redundant_passage(story=True)])
def test_greedy_against_plain_loops(spark, redundant):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 3), s := rng.randint(0, 60), s + rng.randint(0, 14), float(rng.randint(0, 9)), "x") for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, 1, 2, 1.0, "x"), (901, 1, None, 2, 1.0, "x")], "id int, g int, s int, e int, score double, key string")
    kept = []
    for row in sorted(rows, key=lambda r: (-r[4], r[0])):
        if not any(k[1] == row[1] and redundant(row[2], row[3], k[2], k[3]) for k in kept):
            kept.append(row)
    got = [r["id"] for r in I.greedy(df, ["g"], "s", "e", "score", "id", redundant).collect()]
    assert sorted(got) == sorted([r[0] for r in kept] + [900, 901])
    assert I.greedy(df.limit(0), ["g"], "s", "e", "score", "id").count() == 0


@pytest.mark.parametrize("a, b, c, d, story, expected", [
    (1, 10, 3, 4, False, True), (1, 4, 4, 7, False, True), (1, 4, 4, 7, True, False), (1, 4, 4, 20, False, False), (1, 4, 3, 20, False, True), (1, 10, 6, 15, False, False), (1, 10, 5, 14, False, True),
    (1, 10, 5, 14, True, False), (1, 10, 4, 13, True, True), (1, 4, 5, 9, False, False),
])
def test_redundant_passages(a, b, c, d, story, expected):
    assert I.redundant_passage(story=story)(a, b, c, d) == I.redundant_passage(story=story)(c, d, a, b) == expected


class Flaky(R.Sections):
    """Fails on the first try of each section."""

    @staticmethod
    def get(address):
        mark = address + ".tried"
        if os.path.exists(address) and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("broken line")
        return R.fetch(address)


def test_sections(spark, tmp_path):
    for edition, numbers in (("eng-a", (1, 2, 4)), ("ara-a", (1, 3, 4))):
        for n in numbers:
            folder = tmp_path / "editions" / edition / "sections"
            folder.mkdir(parents=True, exist_ok=True)
            items = [{"hadithnumber": n * 10 + k, "text": f"{edition} {n} {k}", "grades": [{"name": "x", "grade": "good"}] if k else None} for k in range(2 + (edition == "eng-a"))]
            (folder / f"{n}.json").write_text(json.dumps({"metadata": {"section": {str(n): f"part {n}"}}, "hadiths": items}))
    (tmp_path / "editions" / "eng-a" / "sections" / "5.json").write_text("{not json")
    for source in (R.Sections, Flaky):
        spark.dataSource.register(source)
        rows = spark.read.format("sections").option("path", str(tmp_path)).option("editions", "eng-a:5,ara-a:5").option("wait", "0.01").load()
        assert rows.rdd.getNumPartitions() == 10 and rows.count() == 15
        pairs = spark.createDataFrame([("eng-a", "ara-a", "A")], "edition string, other string, book string")
        got = sorted((r["section"], r["number"], r["text"], r["other_text"], r["section_name"], len(r["grades"])) for r in R.paired(rows, pairs).collect())
        assert got == [(n, str(n * 10 + k), f"eng-a {n} {k}", f"ara-a {n} {k}", f"part {n}", k) for n in (1, 4) for k in range(2)]
    assert R.fetch_json(str(tmp_path / "none.json")) is None


def test_pcm_stream_carries_a_split_byte_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    data = {k: b"".join(struct.pack("<h", rng.randint(-32768, 32767)) for _ in range(n)) for k, n in (("a", 3000), ("b", 777), ("c", 1))}
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    spark.dataSource.register(R.Pcm)

    def run():
        stream = spark.readStream.format("pcm").option("path", str(folder)).option("block", "1000").load()
        q = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "checkpoint")).start()
        q.processAllAvailable()
        q.stop()

    (folder / "a.pcm").write_bytes(data["a"][:2001])
    (folder / "b.pcm").write_bytes(data["b"][:1])
    (folder / "other.txt").write_bytes(b"xx")
    run()
    for k in data:
        (folder / f"{k}.pcm").write_bytes(data[k])
    run()
    got = {}
    for r in spark.read.parquet(str(out / "rows")).orderBy("key", "start").collect():
        got.setdefault(r["key"], []).append((r["start"], r["samples"]))
    decoder = T.PcmDecoder()
    for k, parts in got.items():
        flat = [x for _, s in parts for x in s]
        assert np.array_equal(np.array(flat, np.float32), decoder.feed(data[k])) and [s for s, _ in parts][0] == 0
    assert set(got) == set(data)


def wav(samples, channels=1):
    body = struct.pack(f"<{len(samples)}h", *samples)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, 16000, 32000 * channels, 2 * channels, 16)
    inner = b"WAVE" + head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def test_corpora_vectors_ids_and_audio(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps([{"chunk_id": "Q_1:1", "surah_id": 1, "grades": [{"name": "a", "grade": "b"}]}, {"chunk_id": "Q_1:2", "extra": 1}], indent=1))
    corpus = T.read_corpus(spark, str(tmp_path / "corpus.json"))
    assert [(r["chunk_id"], r["surah_id"]) for r in corpus.orderBy("chunk_id").collect()] == [("Q_1:1", 1), ("Q_1:2", None)] and corpus.schema == T.CHUNK
    assert [r["chunk_id"] for r in T.by_ids(corpus, ["Q_1:2", "none", "Q_1:1"], "chunk_id").collect()] == ["Q_1:2", "Q_1:1"]
    (tmp_path / "edition.json").write_text(json.dumps({"surahs": [{"ayahs": [{"text": "a"}, {"text": "b"}]}, {"ayahs": [{"text": "c"}]}]}))
    nested = T.explode_editions(spark.read.json(str(tmp_path / "edition.json"), multiLine=True))
    assert sorted(map(tuple, nested.collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    v = str(tmp_path / "vectors")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<float>").write.parquet(v)
    ids = spark.createDataFrame([(1,), (2,)], "vec_id int")
    assert T.read_vectors(spark, v, 2, ids).count() == 2
    for dim, some in ((3, ids), (2, spark.createDataFrame([(5,)], "vec_id int"))):
        with pytest.raises(ValueError):
            T.read_vectors(spark, v, dim, some)
    (tmp_path / "x.wav").write_bytes(wav([0, 16384, -32768]))
    (tmp_path / "y.wav").write_bytes(wav([1, 2, 3, 4], 2))
    (tmp_path / "z.wav").write_bytes(b"no sound")
    got = {r["path"].rsplit("/", 1)[-1]: r["samples"] for r in T.read_wavs(spark, str(tmp_path / "*.wav")).collect()}
    assert got["x.wav"] == [0.0, 0.5, -1.0] and got["y.wav"] == [1 / 32768, 3 / 32768] and got["z.wav"] == []


def test_turns_vocabularies_and_addresses(spark):
    frames = [spark.createDataFrame([(i, n) for i in range(n)], "i int, src int") for n in (3, 1, 2)]
    got = [tuple(r) for r in T.interleave(frames, "i", 5).collect()]
    assert got == [(0, 3), (0, 1), (0, 2), (1, 3), (1, 2)]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.invert_vocabulary(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)))) == {1: "a", 2: "b"}
    assert one(T.audio_url("http://x/y/", F.lit(2), F.lit(255))) == "http://x/y/002255.mp3"
