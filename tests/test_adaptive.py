"""Windows that grow: commits, any way of cutting the sound, restarts, silent keys."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wadi.operators.sequences import frames_of
from wadi.streaming import adaptive as A
from wadi.streaming.windows import with_rocksdb

SMALL = A.Settings(base=320 * 8, expansion=320 * 4, most=3, look=320 * 3, left=320 * 6, pad=320, edge=2, run=2, seam_frames=4, seam_symbols=3)


def recogniser():
    """The level of each frame is its symbol; six symbols, 0 is none."""

    def recognise(sound):
        n = frames_of(len(sound))
        level = np.array([np.abs(sound[f * A.STRIDE : (f + 1) * A.STRIDE]).mean() for f in range(n)])
        symbol = (np.round(level * 10).astype(int)) % 6
        probs = np.full((n, 6), 0.02)
        probs[np.arange(n), symbol] = 0.9
        return probs

    return recognise


def sound(seed, frames=90):
    rng = random.Random(seed)
    levels = []
    while len(levels) < frames:
        levels += [rng.choice([0, 0, 1, 2, 3, 4, 5]) / 10] * rng.randint(1, 5)
    return np.repeat(np.array(levels[:frames], np.float32), A.STRIDE)


def cut(x, rng, most=2000):
    out = []
    while len(x):
        n = rng.randint(0, most)
        out.append(x[:n])
        x = x[n:]
    return out


def test_any_way_of_cutting_gives_the_same():
    for seed in range(6):
        x = sound(seed)
        want = A.fold([x], recogniser(), SMALL)
        for most in (1, 700, 5000):
            some = x[: 320 * 40] if most == 1 else x
            assert A.fold(cut(some, random.Random(seed), max(most, 2)), recogniser(), SMALL) == A.fold([some], recogniser(), SMALL)
        assert [c.start for c in want] == [0, *(c.end for c in want[:-1])] and want[-1].end == len(x)
        assert all((c.end - c.start) % A.STRIDE == 0 and c.end - c.start <= SMALL.full for c in want[:-1])
    assert A.fold([], recogniser(), SMALL) == []


@pytest.mark.parametrize("symbols, frames, grown, used, expected", [
    ([1, 2], [2, 4], 0, 2560, (True, "safely-inside")), ([1, 2], [2, 6], 0, 2560, (False, "edge")), ([2, 2], [1, 3], 0, 2560, (False, "run")),
    ([2, 2], [1, 7], 0, 2560, (False, "edge+run")), ([], [], 0, 2560, (True, "no-tokens")), ([2, 2], [1, 7], 3, 2560, (True, "max-expansions")),
    ([2, 2], [1, 7], 1, SMALL.full, (True, "max-chunk")),
])
def test_verdicts(symbols, frames, grown, used, expected):
    assert A.verdict(symbols, frames, 8, grown, used, SMALL) == expected


def test_frames_tile_and_odd_lengths_are_refused():
    for left in range(0, 5000, 77):
        for n in (1, 5, 40):
            if left >= 400:
                assert frames_of(left + n * A.STRIDE) - frames_of(left) == n
    with pytest.raises(ValueError):
        A.Settings(base=1000)
    assert A.trailing_run([]) == 0 and A.trailing_run([1, 2, 2]) == 2


def rows(key, x, rng, seq0=0, last=True):
    parts = cut(x, rng, 3000)
    return [(key, seq0 + i, datetime(2024, 1, 1) + timedelta(seconds=seq0 + i), [float(v) for v in p], last and i == len(parts) - 1) for i, p in enumerate(parts)]


def put(spark, folder, some):
    spark.createDataFrame(some, "key long, seq long, ts timestamp, samples array<float>, last boolean").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, gap_ms=60_000):
    stream = spark.readStream.schema("key long, seq long, ts timestamp, samples array<float>, last boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    found = A.adaptive_stream(stream.withWatermark("ts", "0 seconds"), recogniser, SMALL, gap_ms)
    with with_rocksdb(spark):
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(found.schema).parquet(f"{out}/rows").collect()
    return {k: [A.Commit(r["start"], r["end"], r["reason"], r["recovered"], r["symbols"], r["frames"]) for r in sorted((r for r in got if r["key"] == k), key=lambda r: r["number"])] for k in {r["key"] for r in got}}


def test_stream_restart_and_expiry(spark, tmp_path):
    """Two runs over one checkpoint give what one fold gives; a key without an end is flushed when its time has passed."""
    rng, folder, out = random.Random(1), str(tmp_path / "in"), str(tmp_path / "out")
    a, b, c = sound(1), sound(2), sound(3, 30)
    first = rows(7, a[:12_345], rng, last=False)
    put(spark, folder, first + rows(9, c, rng, last=False))
    half = run(spark, folder, out)
    assert 9 not in half or half[9][-1].reason != "end"
    put(spark, folder, rows(7, a[12_345:], rng, seq0=len(first)))
    put(spark, folder, rows(8, b, rng, seq0=100_000))
    got = run(spark, folder, out)
    assert got == {7: A.fold([a], recogniser(), SMALL), 8: A.fold([b], recogniser(), SMALL), 9: A.fold([c], recogniser(), SMALL)}
