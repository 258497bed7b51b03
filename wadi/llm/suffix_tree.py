"""Language-model scores by a probabilistic suffix tree.

Symbols are the UTF-8 bytes of the lower-cased (A-Z) words of a text, separated
by one space and closed by a line feed, the end token; the model's states are
contexts of up to ``DEPTH`` symbols (a text begins after a line feed). A context
is kept if its next-symbol counts diverge from those of its suffix, by at least
``GAIN`` nats in N * KL(context || suffix). A kept context mixes its counts with the
distribution of its longest kept suffix (Dirichlet smoothing of mass ``MASS``), the
root with the uniform one; scoring uses the longest kept suffix at each symbol.
The score is the log10 probability of all symbols, so of the words and the end.

The tree has no size bound: runs of DEPTH + 1 symbols are dealt by the three nearest
symbols of their contexts, and each task grows its part of the tree level by level
from the counts of all levels, tests it, and gives every run its log probability.
Contexts of at most two symbols (at most 2 ** 16, whatever the input) are
grown on the driver and broadcast. Of the runs with their log probabilities the
``RUNS`` most frequent are broadcast, as a cache; the others are looked up by a join
on (document, run) rows, so every run has its exact value.

Counting: each task counts the distinct runs of DEPTH + 1 symbols of its texts
(sorted numbers, no objects), the tasks of the tree add them up; runs of held-out
texts count 0. Word counts for the base score go the same way; words of the ``HEAD``
most frequent are looked up in a broadcast of fixed size, the others by a join on
(document, word) rows.

Defined results: a null or empty text is the end token alone; repeated ids are
scored separately; without training rows the model is uniform, all counts 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.storage import cut, drop, fetch
from wadi.llm.textcore import Words, chunks, release

DEPTH, GAIN, RUNS, MASS, HEAD = 6, 2.0, 1 << 21, 12.0, 1 << 18
#: Contexts up to this length are grown on the driver, and longer ones dealt by so many symbols and one more.
LOW = 2
#: Runs that a task of the tree handles at once, and more only if they share their three nearest symbols.
LOT = 500_000
#: Counts that a counting task collects before it adds them up; twice as many distinct ones go out.
HELD = 2_000_000
END, SEP = 0x0A, 0x20
CHUNK = 2 << 20
#: Stands for the end token among word hashes.
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents, each begun by ``DEPTH`` line feeds and closed by one, and their offsets."""
    n_docs = len(words.of) - 1
    size = words.ends - words.starts
    # each document: DEPTH ends, then words with a separator before all but the first, then an end
    first = np.zeros(len(size), bool)
    has = words.of[:-1] < words.of[1:]
    first[words.of[:-1][has]] = True
    gap = (~first).astype(np.int64)
    per_doc = np.zeros(n_docs, np.int64)
    sums = np.concatenate([[0], np.cumsum(size + gap)])
    per_doc = sums[words.of[1:]] - sums[words.of[:-1]]
    offs = np.concatenate([[0], np.cumsum(per_doc + DEPTH + 1)])
    out = np.full(int(offs[-1]), END, np.uint8)
    if len(size):
        doc = words.doc
        at = offs[doc] + DEPTH + (sums[:-1] - sums[words.of[doc]]) + gap
        total = int(size.sum())
        before = np.cumsum(size) - size
        step = np.arange(total)
        out[np.repeat(at - before, size) + step] = words.buf[np.repeat(words.starts - before, size) + step]
        out[at[~first] - 1] = SEP
    return out, offs


def grams(sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every scored symbol, itself (low byte) and the ``DEPTH`` before it, in one number."""
    packed = np.zeros(len(sym), np.uint64)
    packed[:] = sym
    for back in range(1, DEPTH + 1):
        packed[back:] |= sym[:-back].astype(np.uint64) << np.uint64(8 * back)
    keep = np.ones(len(sym), bool)
    for back in range(DEPTH):
        keep[offs[:-1] + back] = False
    return packed[keep]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) of (text, held_out): counts of symbol runs (kind 0) and of words (kind 1), combined over the task as far as memory is bounded."""

    def merged(parts: list) -> list:
        out = []
        for kind in (0, 1):
            keys = np.concatenate([k for t, k, _ in parts if t == kind])
            # of sorted parts, which this sort merges
            order = np.argsort(keys, kind="stable")
            n, keys = np.concatenate([c for t, _, c in parts if t == kind])[order], keys[order]
            first = _starts(keys)
            out.append((kind, keys[first], np.add.reduceat(n, first) if len(first) else n))
        return out

    def rows(parts: list) -> Iterator[pa.RecordBatch]:
        for kind, kinds, n in merged(parts):
            for a in range(0, len(kinds), 100_000):
                k = kinds[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + 100_000])], names=["kind", "key", "n"])

    parts, held, most = [], 0, HELD
    for part in chunks(batches, "text", CHUNK):
        words = Words(part.column(0))
        sym, offs = symbols(words)
        train = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
        h = np.concatenate([words.hashes[train[words.doc]], np.full(int(train.sum()), END_WORD, np.uint64)])
        # a run has seven bytes, so whether it counts goes into the eighth; sorted numbers are faster than a hash table
        runs = np.sort(grams(sym, offs) << np.uint64(8) | np.repeat(train, np.diff(offs) - DEPTH))
        h.sort()
        for kind, kinds, counts in ((0, runs >> np.uint64(8), (runs & np.uint64(1)).astype(np.int64)), (1, h, np.ones(len(h), np.int64))):
            first = _starts(kinds)
            parts.append((kind, kinds[first], np.add.reduceat(counts, first) if len(first) else counts))
            held += len(first)
        if held > most:
            parts = merged(parts)
            held = sum(len(k) for _, k, _ in parts)
            most = held + HELD
            if held > 2 * HELD:
                yield from rows(parts)
                parts, held, most = [], 0, HELD
    if parts:
        yield from rows(parts)


def levels_of(keys: np.ndarray, n: np.ndarray, low: int, depth: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct runs, and for every level from ``low`` to ``depth`` (start, parent, n, context) of its (context, next) entries.

    Runs are sorted by the next symbol, then by the context from its nearest
    symbol on, so the entries of every level are stretches of them: ``start`` is
    an entry's first run, ``parent`` its entry one level below, ``context`` the
    number of its context.
    """
    turned = (keys & np.uint64(255)) << np.uint64(8 * depth)
    for back in range(1, depth + 1):
        turned |= (keys >> np.uint64(8 * back) & np.uint64(255)) << np.uint64(8 * (depth - back))
    order = np.argsort(turned)
    turned, sorted_keys, n = turned[order], keys[order], n[order].astype(float)
    new = np.ones(len(turned), bool)
    np.not_equal(turned[1:], turned[:-1], out=new[1:])
    runs = np.flatnonzero(new)
    turned, sorted_keys, n = turned[runs], sorted_keys[runs], np.add.reduceat(n, runs) if len(runs) else n
    out, above = [], None
    for level in range(low, depth + 1):
        prefix = turned >> np.uint64(8 * (depth - level))
        first = np.ones(len(prefix), bool)
        np.not_equal(prefix[1:], prefix[:-1], out=first[1:])
        start = np.flatnonzero(first)
        context, _ = pd.factorize(prefix[start] & np.uint64((1 << 8 * level) - 1))
        parent = np.zeros(len(start), np.int64) if above is None else np.searchsorted(above, start, "right") - 1
        out.append((start, parent, np.add.reduceat(n, start) if len(start) else n, context))
        above = start
    return sorted_keys, out


def grown(entries: list, logp: np.ndarray | None, below: np.ndarray | None, gain: float, mass: float) -> np.ndarray:
    """Log10 probability of every entry of the last level by its longest kept context.

    ``entries`` are levels one upon the other; ``logp`` and ``below`` are the log
    probabilities and counts' shares of the first of them, which is taken as
    grown; None if that is the root.
    """
    for i, (_, parent, n, context) in enumerate(entries):
        if i == 0 and logp is not None:
            continue
        total = np.bincount(context, weights=n)
        share = n / np.maximum(total, 1)[context]
        if logp is None:
            logp = np.log10((n + mass / 256) / (total + mass)[context]) if len(n) else np.zeros(0)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(n > 0, n * np.log(share / below[parent]), 0.0)
            kept = np.bincount(context, weights=part) >= gain
            under = logp[parent]
            logp = np.where(kept[context], np.log10((n + mass * 10**under) / (total + mass)[context]), under)
        below = share
    return logp


class Low:
    """The tree up to ``LOW`` symbols: its (context, next) entries as sorted keys, their log probabilities and shares."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, gain: float = GAIN, mass: float = MASS):
        runs, entries = levels_of(keys, n, 0, LOW)
        logp = grown(entries, None, None, gain, mass)
        _, _, own, context = entries[-1]
        total = np.bincount(context, weights=own)
        order = np.argsort(runs)
        self.keys, self.logp, self.share = runs[order], logp[order], (own / np.maximum(total, 1)[context])[order]


def _lot(keys: np.ndarray, n: np.ndarray, low: Low, gain: float, mass: float) -> pa.RecordBatch:
    runs, entries = levels_of(keys, n, LOW, DEPTH)
    at = np.searchsorted(low.keys, runs[entries[0][0]] & np.uint64((1 << 8 * (LOW + 1)) - 1))
    logp = grown(entries, low.logp[at], low.share[at], gain, mass)
    return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(entries[-1][2].astype(np.int64)), pa.array(logp)], names=["key", "n", "logp"])


def _logs(batches: Iterator[pa.RecordBatch], held, gain: float, mass: float) -> Iterator[pa.RecordBatch]:
    """(key, n, logp) of the distinct runs of (near, key, n), sorted by near; all runs of a value of near at once."""
    parts, size, near = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).to_numpy()
        keys, n = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        if size >= LOT and (own[0] != near or own[-1] != near):
            cut_at = int(np.searchsorted(own, near, "right"))
            parts.append((keys[:cut_at], n[:cut_at]))
            yield _lot(*(np.concatenate(x) for x in zip(*parts, strict=True)), held.value, gain, mass)
            parts, size = [], 0
            keys, n = keys[cut_at:], n[cut_at:]
        parts.append((keys, n))
        size, near = size + len(keys), own[-1]
    if size:
        yield _lot(*(np.concatenate(x) for x in zip(*parts, strict=True)), held.value, gain, mass)
    parts = None
    release()


def run_logs(runs: DataFrame, gain: float = GAIN, mass: float = MASS) -> DataFrame:
    """(key, n, logp) of all distinct runs from counts (key, n), in which a run may stand several times."""
    few = F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1).cast("long")).alias("key")
    low = fetch(runs.groupBy(few).agg(F.sum("n").alias("n")))
    held = runs.sparkSession.sparkContext.broadcast(Low(low["key"].to_numpy(np.int64).view(np.uint64), low["n"].to_numpy(np.int64), gain, mass))
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1).cast("long")).cast("int")
    dealt = runs.select(near.alias("near"), "key", "n").repartition("near").sortWithinPartitions("near")
    return dealt.mapInArrow(lambda it: _logs(it, held, gain, mass), "key long, n long, logp double")


def frequency(n: Column) -> Column:
    """Classes of counts, at most some 1,000, in the order of the counts."""
    return F.floor(F.log2(n + F.lit(1)) * 16).cast("int")


def least_class(logs: DataFrame, most: int) -> int:
    """The class of frequency from which on there are at most ``most`` runs."""
    sizes = logs.groupBy(frequency(F.col("n")).alias("f")).agg(F.count("*").alias("runs")).collect()
    least, total = 1 << 20, 0
    for row in sorted(sizes, reverse=True):
        total += row["runs"]
        if total > most:
            break
        least = row["f"]
    return least


class Head:
    """The most frequent words: sorted hashes and counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are known, their counts)."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[i] == h
        return hit, np.where(hit, self.n[i], 0)


def _known_runs(runs: np.ndarray, sizes: np.ndarray, run_keys: np.ndarray, run_logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many runs each: sums of the log probabilities that are known, other runs, how often each, and their offsets.

    A run has seven bytes, so the number of one of 256 documents goes into the eighth: sorted, the runs
    pass along the table of known ones in its order, and those of a document that are equal stand together.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums, keys, often, numbers = np.zeros(len(sizes)), [], [], np.zeros(len(sizes), np.int64)
    for a in range(0, len(sizes), 256):
        b = min(a + 256, len(sizes))
        own = runs[ends[a] : ends[b]] << np.uint64(8) | np.repeat(np.arange(b - a, dtype=np.uint64), sizes[a:b])
        own.sort()
        first = _starts(own)
        n, own = np.diff(np.append(first, len(own))), own[first]
        key, doc = own >> np.uint64(8), own.astype(np.uint8)
        starts = _starts(key)
        if len(run_keys):
            kinds = key[starts]
            at = np.minimum(np.searchsorted(run_keys, kinds), len(run_keys) - 1)
            known = run_keys[at] == kinds
            each = np.diff(np.append(starts, len(key)))
            sums[a:b] = np.bincount(doc, weights=n * np.repeat(np.where(known, run_logp[at], 0.0), each), minlength=b - a)
            far = np.flatnonzero(~np.repeat(known, each))
        else:
            far = np.arange(len(key))
        far = far[np.argsort(doc[far], kind="stable")]
        keys.append(key[far])
        often.append(n[far])
        numbers[a:b] = np.bincount(doc[far], minlength=b - a)
    cuts = np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)
    return sums, np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64), np.concatenate([np.zeros(0, np.int64), *often]), cuts


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Rows ``SCORED`` of (row, doc_id, text): what the caches know, the words and the runs (with times) that they do not."""
    run_keys, run_logp, head = held.value
    for part in chunks(batches, "text", CHUNK):
        words = Words(part.column(2))
        sym, offs = symbols(words)
        score, far_keys, times, far_cuts = _known_runs(grams(sym, offs), np.diff(offs) - DEPTH, run_keys, run_logp)
        doc = words.doc
        codes, kinds = pd.factorize(words.hashes)
        hit, n = head.find(kinds)
        known = np.bincount(doc, weights=hit[codes], minlength=part.num_rows).astype(np.int64)
        logn = np.log10(n + 0.1)
        sums = np.bincount(doc, weights=np.where(hit, logn, 0.0)[codes], minlength=part.num_rows)
        rare = np.flatnonzero(~hit[codes])
        rh, rd = words.hashes[rare], doc[rare]
        cuts = np.searchsorted(rd, np.arange(part.num_rows + 1))
        end_hit, end_n = head.find(np.array([END_WORD]))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(np.diff(words.of) + 1),
                pa.array(known + int(end_hit[0])),
                pa.array(sums + math.log10(int(end_n[0]) + 0.1)),
                pa.array(score),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(rh.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(far_cuts), pa.array(far_keys)),
                pa.ListArray.from_arrays(pa.array(far_cuts), pa.array(times.astype(np.int32))),
            ],
            names=["row", "doc_id", "n_tokens", "known", "base", "score", "rare", "runs", "times"],
        )


SCORED = "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<bigint>, runs array<bigint>, times array<int>"


def score(docs: DataFrame, folds: int = 10, cached: int = RUNS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    parts = cut(base.select("text", held_out.alias("held_out")).mapInArrow(_train, "kind int, key long, n long"))
    words = cut(parts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")))
    sums = words.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    n, v = sums["N"] or 0, sums["V"]
    logs = cut(run_logs(parts.where("kind = 0").select("key", "n")))
    drop(parts)
    least_run = least_class(logs, cached)
    top = fetch(logs.where(frequency(F.col("n")) >= least_run).select("key", "logp")).sort_values("key")
    head = fetch(words.orderBy(F.desc("n"), "key").limit(HEAD))
    end = fetch(words.where(F.col("key") == int(END_WORD.astype(np.int64))))
    head = pd.concat([head, end]).drop_duplicates("key")
    held = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64).view(np.uint64), top["logp"].to_numpy(float), Head(head["key"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64))))
    found = cut(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lambda it: _score(it, held), SCORED))
    least = int(head["n"].min()) if len(head) else 0
    rare = found.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("t"))
    tail = words.where(F.col("n") <= least).withColumnRenamed("n", "c")
    extra = rare.join(tail, "key", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("more"), F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rest"))
    asked = found.select("row", F.explode(F.arrays_zip("runs", "times")).alias("r")).select("row", F.col("r.runs").alias("key"), F.col("r.times").alias("t"))
    far = asked.join(logs.where(frequency(F.col("n")) < least_run).select("key", "logp"), "key").groupBy("row").agg(F.sum(F.col("t") * F.col("logp")).alias("far"))
    joined = found.drop("rare", "runs", "times").join(extra, "row", "left").join(far, "row", "left")
    norm = math.log10(n + 0.1 * (v + 1))
    return joined.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
