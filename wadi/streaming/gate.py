"""Speech gate: onset and boundary events from windowed probabilities, as a plain state machine and as a stream.

A run of windows at or above the threshold opens a phrase after ``speech``
windows; a run below it closes the phrase after ``silence`` windows, once. While
open, a loud window (energy floor) counts as speech.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

THRESHOLD, SPEECH, SILENCE = 0.5, 2, 3
STATE = "open boolean, up long, down long, closed boolean, seen long"
EVENTS = "key long, seq long, event string"


class Gate:
    """State of one key: open phrase, run lengths, whether the boundary has been told."""

    def __init__(self, threshold: float = THRESHOLD, speech: int = SPEECH, silence: int = SILENCE, floor: float = 0.0, state: tuple = (False, 0, 0, True, 0)):
        self.threshold, self.speech, self.silence, self.floor = threshold, speech, silence, floor
        self.open, self.up, self.down, self.closed, self.seen = state

    @property
    def state(self) -> tuple:
        return self.open, self.up, self.down, self.closed, self.seen

    def step(self, probability: float, energy: float = 0.0) -> str | None:
        self.seen += 1
        loud = self.open and self.floor > 0 and energy >= self.floor
        if probability >= self.threshold or loud:
            self.up, self.down = self.up + 1, 0
            if not self.open and self.up >= self.speech:
                self.open, self.closed = True, False
                return "speech_start"
        else:
            self.up, self.down = 0, self.down + 1
            if self.down >= self.silence:
                self.open = False
                if not self.closed:
                    self.closed = True
                    return "phrase_boundary"
        return None


def gate_stream(frames: DataFrame, **settings) -> DataFrame:
    """(key, seq, event) from a stream or batch of frames (key, seq, p); state lives in the state store by key.

    Frames of one micro-batch are taken in the order of ``seq``.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(**settings, state=state.get if state.exists else (False, 0, 0, True, 0))
        rows = pd.concat(list(parts)).sort_values("seq")
        out = [(key[0], int(s), e) for s, p in zip(rows["seq"], rows["p"], strict=True) if (e := gate.step(float(p)))]
        state.update(gate.state)
        yield pd.DataFrame(out, columns=["key", "seq", "event"]).astype({"key": "int64", "seq": "int64"})

    return frames.groupBy("key").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def gate_batch(frames: DataFrame) -> DataFrame:
    """The same from a table, with window functions only (default settings, no energy floor).

    Runs of equal sides are found first; a phrase opens in the first long enough
    run of speech after a long enough silence (or the start), and closes in the
    first long enough silence after that.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    side = (F.col("p") >= THRESHOLD).cast("int")
    f = frames.withColumn("side", side)
    f = f.withColumn("run", F.sum(F.when(F.lag("side").over(w).eqNullSafe(F.col("side")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("key", "run").orderBy("seq")))
    marks = f.where(((F.col("side") == 1) & (F.col("n") == SPEECH)) | ((F.col("side") == 0) & (F.col("n") == SILENCE)))
    before = F.lag("side").over(w)
    told = marks.withColumn("before", before).where((F.coalesce("before", F.lit(0)) != F.col("side")))
    return told.select("key", "seq", F.when(F.col("side") == 1, "speech_start").otherwise("phrase_boundary").alias("event"))
