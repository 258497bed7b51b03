"""CTC decoding of a table of frames: N best label sequences, forced alignment, choice by what was expected.

A row is a frame (utterance, frame, logits). Utterances are dealt to tasks and their
frames come sorted, so a task reads them as a stream and never holds a recording: what
it keeps of an utterance that is not at its end is its beam, or, for an alignment, a
byte for each frame and state. The utterances of a batch go step by step together, as
arrays over utterance, hypothesis and symbol.

An utterance is one chain of steps by nature, however long. Frames without logits are
left out, repeated frame numbers follow one another, an utterance without frames gives
no rows; all frames must have as many symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wadi.operators.sequences import log_softmax

WIDTH, BEST = 50, 8
#: Numbers in one array of utterance x hypothesis x symbol.
LOT = 1 << 22
#: Steps back that a beam keeps before those that no hypothesis leads to are dropped.
KEPT = 1 << 20


def _hash(prefix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    x = (prefix ^ (symbol.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Beams:
    """The beams of some utterances: for each hypothesis the log mass that ends in a blank and in its last symbol."""

    def __init__(self, utterances: int, width: int, blank: int):
        shape = utterances, width
        self.width, self.blank = width, blank
        self.in_blank, self.in_last = np.full(shape, -np.inf), np.full(shape, -np.inf)
        self.in_blank[:, 0] = 0.0
        self.last = np.full(shape, -1)
        self.prefix, self.before = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.node = np.full(shape, -1)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []  # (node before, symbol) of nodes, in their order
        self.nodes = 0

    _ARRAYS = ("in_blank", "in_last", "last", "prefix", "before", "node")

    def step(self, logs: np.ndarray) -> None:
        """A frame of each of the first utterances: log probabilities by utterance and symbol."""
        u, symbols = logs.shape
        in_blank, in_last, last, prefix, before, node = (getattr(self, name)[:u] for name in self._ARRAYS)
        rows, slots = np.arange(u)[:, None], np.arange(self.width)
        total = np.logaddexp(in_blank, in_last)
        some = last >= 0
        own = np.where(some, logs[rows, np.maximum(last, 0)], -np.inf)
        more = total[:, :, None] + logs[:, None, :]
        more[:, :, self.blank] = -np.inf
        more[rows, slots, np.maximum(last, 0)] = np.where(some, in_blank + own, more[rows, slots, np.maximum(last, 0)])
        stay_blank, stay_last = total + logs[:, self.blank, None], in_last + own
        # an extension that is a hypothesis already adds to it
        parent = (before[:, :, None] == prefix[:, None, :]) & (some & (total > -np.inf))[:, :, None] & (total > -np.inf)[:, None, :]
        a, i, j = np.nonzero(parent)
        stay_last[a, i] = np.logaddexp(stay_last[a, i], more[a, j, last[a, i]])
        more[a, j, last[a, i]] = -np.inf
        flat = more.reshape(u, -1)
        n = min(self.width, flat.shape[1])
        top = np.sort(np.argpartition(-flat, n - 1, axis=1)[:, :n], axis=1) if n < flat.shape[1] else np.broadcast_to(np.arange(n), (u, n))
        from_slot, symbol = top // symbols, top % symbols
        extended = flat[rows, top]
        mass = np.concatenate([np.logaddexp(stay_blank, stay_last), extended], axis=1)
        chosen = np.argsort(-mass, axis=1, kind="stable")[:, : self.width]
        old = chosen < self.width
        slot = np.where(old, chosen, 0)
        new = np.where(old, 0, chosen - self.width)
        origin = np.where(old, slot, from_slot[rows, new])
        put = symbol[rows, new]
        reached = mass[rows, chosen] > -np.inf
        fresh = ~old & reached
        number = self.nodes + np.cumsum(fresh.ravel()).reshape(fresh.shape) - 1
        self.steps.append((node[rows, origin][fresh], put[fresh]))
        self.nodes += int(fresh.sum())
        self.in_blank[:u] = np.where(old, stay_blank[rows, slot], -np.inf)
        self.in_last[:u] = np.where(old, stay_last[rows, slot], extended[rows, new])
        grown = prefix[rows, origin]
        self.before[:u], self.prefix[:u] = np.where(old, before[rows, slot], grown), np.where(old, grown, _hash(grown, put))
        self.last[:u] = np.where(old, last[rows, slot], put)
        self.node[:u] = np.where(old, node[rows, slot], number)

    def _tree(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.steps) != 1:
            parts = self.steps or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            self.steps = [tuple(np.concatenate(c) for c in zip(*parts, strict=True))]
        return self.steps[0]

    def best(self, u: int, n: int) -> list[tuple[list[int], float]]:
        """The n likeliest label sequences of an utterance with their log probability."""
        before, symbol = self._tree()
        mass = np.logaddexp(self.in_blank[u], self.in_last[u])
        out = []
        for slot in np.argsort(-mass, kind="stable")[:n]:
            if mass[slot] == -np.inf:
                break
            labels, at = [], int(self.node[u, slot])
            while at >= 0:
                labels.append(int(symbol[at]))
                at = int(before[at])
            out.append((labels[::-1], float(mass[slot])))
        return out

    def only(self, u: int) -> Beams:
        """The beam of one utterance, with the steps that lead to its hypotheses."""
        out = Beams(1, self.width, self.blank)
        for name in self._ARRAYS:
            setattr(out, name, getattr(self, name)[u : u + 1].copy())
        before, symbol = self._tree()
        used = np.zeros(len(before) + 1, bool)
        at = np.unique(out.node[0])
        while (at := at[(at >= 0) & ~used[at]]).size:
            used[at] = True
            at = np.unique(before[at])
        used[-1] = False
        kept = np.flatnonzero(used)
        number = np.full(len(before) + 1, -1)
        number[kept] = np.arange(len(kept))
        out.node = number[out.node]
        out.steps, out.nodes = [(number[before[kept]], symbol[kept])], len(kept)
        return out


def _segments(column: pa.Array) -> np.ndarray:
    """Bounds of runs of equal values."""
    n = len(column)
    new = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) % len(column):
        raise ValueError("frames must have as many symbols")
    return flat.reshape(len(column), -1)


def _best(batches: Iterator[pa.RecordBatch], width: int, n: int, blank: int) -> Iterator[pa.RecordBatch]:
    """(utterance, rank, symbols, log_prob) from (utterance, logits), the frames of an utterance in a row."""
    open_key, open_beam = None, None

    def rows(keys: pa.Array, found: list[list[tuple[list[int], float]]]) -> pa.RecordBatch:
        which = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        flat = [x for f in found for x in f]
        return pa.RecordBatch.from_arrays([keys.take(which), pa.array([r for f in found for r in range(len(f))], pa.int32()), pa.array([s for s, _ in flat], pa.list_(pa.int32())), pa.array([p for _, p in flat], pa.float64())], names=["utterance", "rank", "symbols", "log_prob"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, logs = _segments(batch.column(0)), log_softmax(_matrix(batch.column(1)))
        starts, sizes = bounds[:-1], np.diff(bounds)
        keys = batch.column(0).take(pa.array(starts))
        if open_beam is not None and keys[0].as_py() != open_key.as_py():
            yield rows(pa.array([open_key.as_py()], keys.type), [open_beam.best(0, n)])
            open_beam = None
        per = max(1, LOT // (width * logs.shape[1]))
        for a in range(0, len(starts), per):
            b = min(a + per, len(starts))
            order = a + np.argsort(-sizes[a:b], kind="stable")
            beams = Beams(b - a, width, blank)
            if a == 0 and open_beam is not None:
                at = int(np.flatnonzero(order == 0)[0])
                for name in Beams._ARRAYS:
                    getattr(beams, name)[at] = getattr(open_beam, name)[0]
                beams.steps, beams.nodes = list(open_beam.steps), open_beam.nodes
            for t in range(int(sizes[a:b].max())):
                active = int(np.searchsorted(-sizes[order], -t, "left"))
                beams.step(logs[starts[order[:active]] + t])
                if beams.nodes > KEPT and b - a == 1:
                    beams = beams.only(0)
            place = np.empty(b - a, np.int64)
            place[order - a] = np.arange(b - a)
            done = b - a - (b == len(starts))
            if done:
                yield rows(keys.slice(a, done), [beams.best(int(place[i]), n) for i in range(done)])
            if b == len(starts):
                open_key, open_beam = keys[b - 1], beams.only(int(place[-1]))
    if open_beam is not None:
        yield rows(pa.array([open_key.as_py()], open_key.type), [open_beam.best(0, n)])


def _sorted(frames: DataFrame) -> DataFrame:
    return frames.repartition("utterance").sortWithinPartitions("utterance", "frame")


def n_best(frames: DataFrame, width: int = WIDTH, n: int = BEST, blank: int = 0) -> DataFrame:
    """(utterance, rank, symbols, log_prob): the n best of a prefix beam search over (utterance, frame, logits)."""
    rows = frames.select("utterance", "frame", F.col("logits").cast("array<double>").alias("logits")).where("utterance IS NOT NULL AND logits IS NOT NULL")
    kind = frames.schema["utterance"].dataType.simpleString()
    return _sorted(rows).select("utterance", "logits").mapInArrow(lambda it: _best(it, width, n, blank), f"utterance {kind}, rank int, symbols array<int>, log_prob double")


class Alignment:
    """The best path of one utterance through its target with blanks between the symbols."""

    def __init__(self, target: list[int], blank: int):
        self.states = np.full(2 * len(target) + 1, blank)
        self.states[1::2] = target
        self.score: np.ndarray | None = None
        self.came: list[np.ndarray] = []
        skip = np.zeros(len(self.states), bool)
        skip[2:] = (self.states[2:] != blank) & (self.states[2:] != self.states[:-2])
        self.no_skip = ~skip

    def step(self, logs: np.ndarray) -> None:
        own, n = logs[self.states], len(self.states)
        if self.score is None:
            self.score = np.full(n, -np.inf)
            self.score[:2] = own[:2]
            self.came.append(np.zeros(n, np.uint8))
            return
        ways = np.full((3, n), -np.inf)
        ways[0], ways[1, 1:], ways[2, 2:] = self.score, self.score[:-1], self.score[:-2]
        ways[2, self.no_skip] = -np.inf
        came = ways.argmax(axis=0)  # of equal ways the one that moves least
        self.score = ways[came, np.arange(n)] + own
        self.came.append(came.astype(np.uint8))

    def path(self) -> list[int] | None:
        """A symbol for each frame; None if the frames are too few for the target."""
        n = len(self.states)
        at = n - 1 if n == 1 or self.score[n - 1] >= self.score[n - 2] else n - 2
        if self.score[at] == -np.inf:
            return None
        out = []
        for came in reversed(self.came):
            out.append(int(self.states[at]))
            at -= int(came[at])
        return out[::-1]


def _forced(batches: Iterator[pa.RecordBatch], blank: int) -> Iterator[pa.RecordBatch]:
    """(utterance, frame, symbol) from rows (utterance, frame, target, logits), the one with the target first."""
    key, at, numbers = None, None, []

    def rows(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        path = at.path() if at is not None and numbers else None
        if path:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(path), kind), pa.array(numbers, pa.int64()), pa.array(path, pa.int32())], names=["utterance", "frame", "symbol"])

    for batch in batches:
        keys, frames, targets = (batch.column(i).to_pylist() for i in range(3))
        kind = batch.schema.field(0).type
        known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        logs = log_softmax(_matrix(batch.column(3).drop_null())) if known.any() else np.zeros((0, 1))
        row = np.cumsum(known) - 1
        for i, k in enumerate(keys):
            if not known[i]:
                yield from rows(kind)
                key, at, numbers = k, Alignment(targets[i], blank), []
            elif k == key:
                at.step(logs[row[i]])
                numbers.append(frames[i])
    if at is not None:
        yield from rows(kind)


def forced_alignment(frames: DataFrame, targets: DataFrame, blank: int = 0) -> DataFrame:
    """(utterance, frame, symbol): the likeliest symbol of each frame such that they spell the target (utterance, target array<int>, one row each); utterances without a target, or too short for it, give no rows."""
    head = targets.select("utterance", F.lit(None).cast("long").alias("frame"), F.col("target").cast("array<int>").alias("target"), F.lit(None).cast("array<double>").alias("logits")).where("target IS NOT NULL")
    rows = frames.select("utterance", F.col("frame").cast("long").alias("frame"), F.lit(None).cast("array<int>").alias("target"), F.col("logits").cast("array<double>").alias("logits")).where("logits IS NOT NULL AND frame IS NOT NULL")
    kind = frames.schema["utterance"].dataType.simpleString()
    both = head.unionByName(rows).where("utterance IS NOT NULL")
    return _sorted(both).mapInArrow(lambda it: _forced(it, blank), f"utterance {kind}, frame long, symbol int")


def spelled(path: DataFrame, blank: int = 0) -> DataFrame:
    """(utterance, symbol, first, frames): runs of equal symbols of a path (utterance, frame, symbol), blanks left out."""
    w = Window.partitionBy("utterance").orderBy("frame")
    new = F.when(F.lag("symbol").over(w).eqNullSafe(F.col("symbol")), 0).otherwise(1)
    runs = path.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where(F.col("symbol") != blank).groupBy("utterance", "run", "symbol").agg(F.min("frame").alias("first"), F.count("*").alias("frames")).drop("run")


def nearest(best: DataFrame, expected: DataFrame, text: str = "text") -> DataFrame:
    """Of the hypotheses (utterance, rank, ``text``, ...) the one with the fewest edits from (utterance, expected), of equals the likeliest."""
    both = best.join(expected, "utterance").withColumn("edits", F.levenshtein(F.col(text), F.regexp_replace("expected", r"\s+", "")))
    others = [c for c in best.columns if c not in ("utterance", "rank")]
    chosen = both.groupBy("utterance").agg(F.min_by(F.struct("rank", "edits", *others), F.struct("edits", "rank")).alias("m"))
    return chosen.select("utterance", "m.*")
