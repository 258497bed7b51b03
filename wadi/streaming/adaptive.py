"""Windows over sound that grow until their end is safe, as keyed state of a stream.

Sound comes in blocks cut anywhere. A window takes ``base`` of it, with ``left`` of what
was committed before and ``look`` of what follows as context, and is recognised as a
whole. It is committed if its last symbol peaks well before its edge and is no run of
equal symbols; else it grows by ``expansion``, ``most`` times at most, and is recognised
again. A window without symbols, or of full size, is committed as it is. At a commit the
frames just before the window are read again with the new context: what they have beyond
the end of the symbols known so far comes first (``sequences.seam``). At the end of the
sound, or when none has come for ``gap``, what is left is committed as the final window.

Committed lengths are multiples of a frame, so that the frames of successive windows
tile the sound without a gap or an overlap. The result does not depend on how the sound
was cut into blocks. State of a key: blocks not committed yet (list state; at most a
full window with its look-ahead, and the block that came last), the left context and
some numbers (value state), and one timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wadi.operators.sequences import ctc_greedy, frames_of, seam

#: Samples of a frame.
STRIDE = 320
#: Sound to frames x probabilities of symbols; symbol 0 is none.
Recogniser = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Settings:
    """Lengths in samples (of 16,000 a second), frames or symbols."""

    base: int = 24_000
    expansion: int = 8_000
    most: int = 3
    look: int = 8_000
    left: int = 16_000
    pad: int = 800
    edge: int = 3
    run: int = 2
    seam_frames: int = 10
    seam_symbols: int = 6

    def __post_init__(self) -> None:
        if self.base <= 0 or self.base % STRIDE or self.expansion % STRIDE:
            raise ValueError(f"base and expansion must be multiples of {STRIDE} samples")

    @property
    def full(self) -> int:
        return self.base + self.most * self.expansion


@dataclass(frozen=True)
class Commit:
    """A window: its samples in the whole sound, why it ended, symbols recovered before it and its own with the frames of their peaks."""

    start: int
    end: int
    reason: str
    recovered: list[int]
    symbols: list[int]
    frames: list[int]


def trailing_run(symbols: list[int]) -> int:
    """How often the last symbol stands at the end."""
    n = 0
    while n < len(symbols) and symbols[-1 - n] == symbols[-1]:
        n += 1
    return n


def verdict(symbols: list[int], frames: list[int], frame_end: int, grown: int, used: int, s: Settings) -> tuple[bool, str]:
    """Whether a window is committed, and why or why not."""
    if grown >= s.most:
        return True, "max-expansions"
    if used >= s.full:
        return True, "max-chunk"
    if not symbols:
        return True, "no-tokens"
    at_edge = bool(frames) and frames[-1] >= frame_end - s.edge
    held = s.run > 0 and trailing_run(symbols) >= s.run
    if at_edge or held:
        return False, "edge+run" if at_edge and held else "edge" if at_edge else "run"
    return True, "safely-inside"


@dataclass
class Carry:
    """What a key remembers besides the sound that is not committed yet."""

    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    grown: int = 0
    tail: list[int] = field(default_factory=list)
    done: int = 0

    def window(self, chunk: np.ndarray, take: int, look: int, recognise: Recogniser, s: Settings) -> tuple[np.ndarray, int, int]:
        """Probabilities of the window's frames, and which of them are its own."""
        used = chunk[:take]
        sound = np.concatenate([self.left, used, chunk[take : take + look], np.zeros(s.pad, np.float32)])
        start = frames_of(len(self.left))
        end = max(frames_of(len(self.left) + len(used)), start + 1)
        return recognise(sound), start, end

    def commit(self, chunk: np.ndarray, take: int, probs: np.ndarray, start: int, end: int, reason: str, s: Settings) -> Commit:
        found = ctc_greedy(probs[start:end])
        symbols, recovered = [f[0] for f in found], []
        if start > 0 and self.tail and s.seam_frames:
            again = [f[0] for f in ctc_greedy(probs[max(0, start - s.seam_frames) : start])]
            rest = seam(self.tail, again, s.seam_symbols)
            recovered = rest if len(rest) < len(again) else []  # what does not overlap cannot be placed
        out = Commit(self.done, self.done + take, reason, recovered, symbols, [start + f[1] for f in found])
        self.left = np.concatenate([self.left, chunk[:take]])[-s.left :] if s.left else self.left[:0]
        self.tail = (self.tail + recovered + symbols)[-max(s.seam_symbols, 1) :]
        self.grown, self.done = 0, self.done + take
        return out

    def decode(self, chunk: np.ndarray, recognise: Recogniser, s: Settings) -> tuple[list[Commit], np.ndarray]:
        """What can be committed of the sound, and what is left of it."""
        out = []
        while True:
            take = min(s.base + self.grown * s.expansion, s.full)
            if len(chunk) < take + s.look:
                return out, chunk
            probs, start, end = self.window(chunk, take, s.look, recognise, s)
            found = ctc_greedy(probs[start:end])
            ready, reason = verdict([f[0] for f in found], [start + f[1] for f in found], end, self.grown, take, s)
            if ready:
                out.append(self.commit(chunk, take, probs, start, end, reason, s))
                chunk = chunk[take:]
            else:
                self.grown += 1

    def flush(self, chunk: np.ndarray, recognise: Recogniser, s: Settings) -> list[Commit]:
        """The final window, of all that is left."""
        if not len(chunk):
            return []
        return [self.commit(chunk, len(chunk), *self.window(chunk, len(chunk), 0, recognise, s), "end", s)]


def fold(blocks: list[np.ndarray], recognise: Recogniser, s: Settings) -> list[Commit]:
    """All windows of one sound."""
    carry, chunk, out = Carry(), np.zeros(0, np.float32), []
    for block in blocks:
        some, chunk = carry.decode(np.concatenate([chunk, block.astype(np.float32)]), recognise, s)
        out += some
    return out + carry.flush(chunk, recognise, s)


OUTPUT = "key long, number long, start long, end long, reason string, recovered array<int>, symbols array<int>, frames array<int>"


class AdaptiveWindows(StatefulProcessor):
    """Rows (key, seq, samples array<float>, last boolean, ms long) in the order of ``seq`` to commits."""

    def __init__(self, recogniser: Callable[[], Recogniser], settings: Settings, gap_ms: int):
        self.recogniser, self.settings, self.gap_ms = recogniser, settings, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recognise = handle, self.recogniser()
        self.sound = handle.getListState("sound", "samples binary")
        self.carry = handle.getValueState("carry", "left binary, grown int, tail array<int>, done long, held long, number long")

    def _load(self) -> tuple[Carry, int, int]:
        if not self.carry.exists():
            return Carry(), 0, 0
        left, grown, tail, done, held, number = self.carry.get()
        return Carry(np.frombuffer(left, np.float32), grown, list(tail), done), held, number

    def _chunk(self) -> np.ndarray:
        parts = [np.frombuffer(r[0], np.float32) for r in self.sound.get()] if self.sound.exists() else []
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def _rows(self, key: tuple, commits: list[Commit], number: int) -> pd.DataFrame:
        rows = [(key[0], number + i, c.start, c.end, c.reason, c.recovered, c.symbols, c.frames) for i, c in enumerate(commits)]
        return pd.DataFrame(rows, columns=["key", "number", "start", "end", "reason", "recovered", "symbols", "frames"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.settings
        carry, held, number = self._load()
        fresh: list[np.ndarray] = []  # blocks that the state does not have yet
        latest = None
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            block = np.asarray(r.samples, np.float32) if r.samples is not None else np.zeros(0, np.float32)
            if len(block):
                fresh.append(block)
                held += len(block)
            # the blocks are read only when they can fill the window that is due
            if held >= min(s.base + carry.grown * s.expansion, s.full) + s.look:
                commits, left = carry.decode(np.concatenate([self._chunk(), *fresh]), self.recognise, s)
                self.sound.clear()
                fresh, held = [left] if len(left) else [], len(left)
                if commits:
                    yield self._rows(key, commits, number)
                    number += len(commits)
            if r.last:
                commits = carry.flush(np.concatenate([self._chunk(), *fresh]), self.recognise, s)
                if commits:
                    yield self._rows(key, commits, number)
                self.sound.clear()
                carry, held, number, fresh, latest = Carry(), 0, 0, [], None
            else:
                latest = max(latest or 0, r.ms)
        self._forget_timers()
        if fresh:
            self.sound.appendList([(block.tobytes(),) for block in fresh])
        if latest is None:
            self.carry.clear()
        else:
            self.carry.update((carry.left.tobytes(), carry.grown, list(carry.tail), carry.done, held, number))
            self.handle.registerTimer(latest + self.gap_ms)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        carry, _, number = self._load()
        commits = carry.flush(self._chunk(), self.recognise, self.settings)
        self.sound.clear()
        self.carry.clear()
        if commits:
            yield self._rows(key, commits, number)

    def close(self) -> None:
        pass


def adaptive_stream(blocks: DataFrame, recogniser: Callable[[], Recogniser], settings: Settings | None = None, gap_ms: int = 60_000) -> DataFrame:
    """Commits of a stream of (key, seq, ts, samples, last), with a watermark on ``ts``; ``recogniser`` is called once for each task."""
    processor = AdaptiveWindows(recogniser, settings or Settings(), gap_ms)
    rows = blocks.select("key", "seq", "ts", "samples", "last", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")
