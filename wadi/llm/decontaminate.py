"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (runs of letters, digits and non-ASCII
characters, A-Z as small letters). An item of n words leaks if some passage of a
document is within floor(``SLACK`` * n) word edits of it.

CGK: a walk over a window copies its current word and then moves on or stays,
by a random bit of the step and the word. Equal parts of two windows bring their
walks together again, so few edits become few differing steps. ``WALKS`` walks
are embedded for every item-sized window, ``TABLES`` samples of ``SAMPLED``
steps of each are looked up among those of the items (by class of item length,
so that sampled steps lie inside the item), and what falls together is verified
by exact edit distance, aligned freely within the document. With 20 % edits
this misses well below 1 % (tests measure it against brute force).

Windows are taken only near exact runs that an item shares: a passage within d
edits of n words keeps a run of floor(n / (d + 1)) words (pigeonhole), at most
``RUN`` are asked for, so this drops no leak.

Items are broadcast in slices of at most ``ITEM_SLICE``, the documents being
scanned once for each slice: nothing that grows is broadcast, no document is
shuffled.

Defined results: null and empty texts have no leaks; an item without words
cannot leak, items of fewer than five words leak only as they are; repeated
documents report each for itself; equal items are reported under each id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.textcore import NON_ALNUM, Words, chunks, mix

SLACK, RUN, WALKS, TABLES, SAMPLED, ITEM_SLICE = 0.2, 4, 8, 4, 2, 20_000
#: Bounds of the classes of item length; sampled steps lie below twice the lower bound.
CLASSES = (1, 5, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 1 << 30)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _class(n: int) -> int:
    return max(c for c in range(len(CLASSES) - 1) if CLASSES[c] <= n)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * np.uint64(pow(int(_STEP), j, 1 << 64))
    return mix(out)


class Items:
    """Benchmark items and everything that the search needs of them."""

    def __init__(self, rows: list[tuple[int, str]], slack: float = SLACK, run: int = RUN):
        words = Words(pa.array([t or "" for _, t in rows], pa.string()), NON_ALNUM)
        self.ids, self.words, self.slack_of, self.run_of = [], [], [], []
        for (item, _), a, b in zip(rows, words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
            if b > a:
                n = b - a
                d = int(slack * n) if n >= 5 else 0
                self.ids.append(item)
                self.words.append(words.hashes[a:b])
                self.slack_of.append(d)
                self.run_of.append(max(1, min(run, n // (d + 1))))
        self.runs = {}
        for k in sorted(set(self.run_of)):
            found = [(_runs(w, k), i) for i, w in enumerate(self.words) if self.run_of[i] == k]
            keys = np.concatenate([r for r, _ in found])
            owner = np.concatenate([np.full(len(r), i) for r, i in found])
            at = np.concatenate([np.arange(len(r)) for r, _ in found])
            order = np.argsort(keys, kind="stable")
            keys, owner, at = keys[order], owner[order], at[order]
            bloom = np.zeros(1 << 20, bool)
            bloom[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.runs[k] = keys, owner, at, bloom
        self.classes = {}
        for c in sorted({_class(len(w)) for w in self.words}):
            own = [i for i, w in enumerate(self.words) if _class(len(w)) == c]
            flat = np.concatenate([self.words[i] for i in own])
            starts = np.cumsum([0] + [len(self.words[i]) for i in own])
            tables = {}
            for (w, t), keys in sketches(flat, starts[:-1], starts[1:], c).items():
                order = np.argsort(keys, kind="stable")
                tables[w, t] = keys[order], np.array(own)[order]
            self.classes[c] = tables, np.array(own)


def samples(c: int) -> dict[int, list[np.ndarray]]:
    """Sampled steps of the class's walks, sorted, by walk and table."""
    steps = max(1, 2 * CLASSES[c] - 1)
    rng = np.random.default_rng(1000 + c)
    return {w: [np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(TABLES)] for w in range(WALKS)}


def sketches(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: int) -> dict[tuple[int, int], np.ndarray]:
    """Keys of windows [start, end) by (walk, table); past its end a window reads as padding."""
    out = {}
    n = len(words)
    padded = np.append(words, np.uint64(0))
    for walk, tables in samples(c).items():
        at = starts.astype(np.int64).copy()
        keys = [np.full(len(starts), t + 1, np.uint64) for t in range(len(tables))]
        for step in range(max(int(t[-1]) for t in tables) + 1):
            word = np.where(at < ends, padded[np.minimum(at, n)], np.uint64(0))
            for t, chosen in enumerate(tables):
                if step in chosen:
                    keys[t] = mix(keys[t] * _STEP + word)
            salt = np.uint64((walk * 65_536 + step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            at += (mix(word + salt) & np.uint64(1)).astype(np.int64)
        for t, k in enumerate(keys):
            out[walk, t] = mix(k + np.uint64(walk * 1024 + t))
    return out


def best_alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of ``region`` nearest to ``item``; of equals the first that ends."""
    m = len(region)
    cols = np.arange(m + 1)
    cost, origin = np.zeros(m + 1, np.int64), cols.copy()
    for i, w in enumerate(item, 1):
        sub = cost[:-1] + (region != w)
        ins = cost[1:] + 1  # the item's word is missing in the region
        new, src = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], src[0] = i, 0
        take = sub <= ins
        new[1:] = np.where(take, sub, ins)
        src[1:] = np.where(take, origin[:-1], origin[1:])
        # an extra word of the region: the best of what lies to the left, one edit for each column
        slack = new - cols
        low = np.minimum.accumulate(slack)
        first = np.maximum.accumulate(np.where(slack == low, cols, 0))
        cost, origin = low + cols, src[first]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def leaks_in(h: np.ndarray, of: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document, item index, start, end, edits) of every leak in a chunk of documents.

    ``h`` holds the words of all of them, ``of`` the document bounds in it; starts
    and ends count in the document.
    """
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    length = np.array([len(w) for w in items.words])
    hits: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for k, (keys, owner, at, bloom) in items.runs.items():
        runs = _runs(h, k)
        maybe = np.flatnonzero(bloom[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
        maybe = maybe[doc[maybe] == doc[maybe + k - 1]]
        a, b = np.searchsorted(keys, runs[maybe], "left"), np.searchsorted(keys, runs[maybe], "right")
        n = b - a
        if not n.sum():
            continue
        place = np.repeat(maybe, n)
        row = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        kinds = np.array([_class(x) for x in length[owner[row]].tolist()])
        for c in np.unique(kinds).tolist():
            on = kinds == c
            hits.setdefault(c, []).append((place[on] - at[row[on]], owner[row[on]], doc[place[on]]))
    out = []
    for c, found in hits.items():
        start, item, own_doc = (np.concatenate([f[x] for f in found]) for x in range(3))
        out += _verify(h, of, items, c, start, item, own_doc)
    return out


def _verify(h: np.ndarray, of: np.ndarray, items: Items, c: int, near: np.ndarray, item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Embeds the windows near the runs, looks them up, aligns what fell together."""
    tables, own = items.classes[c]
    slack = np.array(items.slack_of)[item]
    seen = np.unique(np.stack([near, slack, doc]), axis=1)
    near, slack, doc = seen
    n = 2 * slack + 1
    shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) - np.repeat(slack, n)
    doc = np.repeat(doc, n)
    starts = np.repeat(near, n) + shift
    inside = (starts >= of[doc]) & (starts < of[doc + 1])
    starts, first = np.unique(starts[inside], return_index=True)
    doc = doc[inside][first]
    if not len(starts):
        return []
    longest = max(len(items.words[i]) for i in own.tolist())
    met: set[tuple[int, int, int]] = set()
    for key, got in sketches(h, starts, np.minimum(starts + longest, of[doc + 1]), c).items():
        keys, owner = tables[key]
        a, b = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
        for j in np.flatnonzero(b > a).tolist():
            met.update((int(doc[j]), i, int(starts[j])) for i in owner[a[j] : b[j]].tolist())
    out, last, done = [], None, -1
    for d, i, s in sorted(met):
        if (d, i) != last:
            last, done = (d, i), -1
        if s < done:
            continue
        words, spare = items.words[i], items.slack_of[i]
        a, b = max(int(of[d]), s - spare), min(int(of[d + 1]), s + len(words) + 2 * spare)
        region = h[a:b]
        if len(words) - int(np.isin(words, region).sum()) > spare:
            continue  # more words of the item are missing than there may be edits
        edits, x, y = best_alignment(words, region)
        if edits <= spare:
            out.append((d, i, a + x - int(of[d]), a + y - int(of[d]), edits))
            done = a + y
    return out


RESULT = "doc_id long, item_id long, start_word long, end_word long, edits long"


def _scan(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    items, out = held.value, []
    for part in chunks(batches, "text"):
        words = Words(part.column(1), NON_ALNUM)
        ids = part.column(0).to_pylist()
        out += [(ids[d], items.ids[i], x, y, e) for d, i, x, y, e in leaks_in(words.hashes, words.of, items)]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "edits"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "edits"])


def leaks(docs: DataFrame, benchmark: DataFrame, slack: float = SLACK, item_slice: int = ITEM_SLICE) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits) for every leaked passage."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, lot = None, []

    def add(lot: list) -> None:
        nonlocal found
        items = Items(lot, slack)
        if items.ids:
            held = spark.sparkContext.broadcast(items)
            part = rows.mapInArrow(lambda it: _scan(it, held), RESULT)
            found = part if found is None else found.union(part)

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        lot.append((r["item_id"], r["text"]))
        if len(lot) == item_slice:
            add(lot)
            lot = []
    if lot:
        add(lot)
    return found if found is not None else spark.createDataFrame([], RESULT)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
