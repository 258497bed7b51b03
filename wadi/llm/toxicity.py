"""Toxic passages by maximum-scoring segment search.

Model: log-odds of a token between toxic and other labelled texts. A token is
backed off through its prefixes: each of prefix and whole word has a Dirichlet
(two-class) prior of mass ``PRIOR`` centred on the rate of the next shorter
kept prefix, the shortest on the overall rate. Counts are damped by document
(t times weigh 1 + floor(log2 t)), so no single text makes a token. Only tokens
of at least ``MIN_TOXIC`` toxic texts and significantly above the overall rate
are kept, all of them: the model is bounded by the words of the labelled rows.

Scan: each word scores its log-odds minus a drift, so that the expected score
of ordinary text is negative; a linear scan finds all maximal scoring
segments. A segment of score S in a text of n words is significant if
lambda * S - ln(K * n) > 0, where the extreme-value (Gumbel) parameters lambda
and K come from the best segments of the non-toxic training texts. The
normalised best score and the sum over significant segments go through a
logistic calibration. Model and calibration are fitted on at most
``LABELLED_ROWS`` labelled rows (the first by a hash of their id; of rows that
repeat an id, the calibration sees as many), so their list can be broadcast to
the texts, which are never shuffled.

Defined results: null and empty texts have no segments and the score that the
calibration gives to no evidence; labels that are null or not 0/1 are left
out; a document labelled twice counts once, as toxic if any label says so;
without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.storage import cut, drop, fetch
from wadi.llm.textcore import NON_ALNUM, Words, chunks, mix

PREFIXES = (4, 5, 6, 7, 8, 9)
PRIOR, DRIFT, LABELLED_ROWS = 4.0, 0.5, 1 << 17
MIN_TOXIC, MIN_Z, MOST_RATE = 3, 3.0, 0.999


def held_out(id_col="doc_id", folds: int = 5):
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def _levels(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, word indices, hashes): prefixes of words longer than them, then whole words."""
    length = words.ends - words.starts
    out = []
    for n in PREFIXES:
        at = np.flatnonzero(length > n)
        out.append((n, at, words.spans(words.starts[at], words.starts[at] + n)))
    out.append((0, np.arange(len(words)), words.hashes))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, token, toxic, total, docs) by chunk; a token that a text has t times weighs 1 + floor(log2 t)."""
    for part in chunks(batches, "text"):
        words = Words(part.column(0), NON_ALNUM)
        marks = np.asarray(part.column(1).to_pylist(), np.int64)
        doc = words.doc
        salt = mix(np.arange(part.num_rows, dtype=np.uint64) + np.uint64(1))
        for level, at, h in _levels(words):
            pairs, _, first = _unique(h ^ salt[doc[at]])
            times = np.bincount(pairs, minlength=len(first))
            weight = 1 + np.log2(np.maximum(times, 1)).astype(np.int64)
            bad = marks[doc[at[first]]]
            codes, kinds = pd.factorize(h[first])
            add = lambda w: np.bincount(codes, weights=w, minlength=len(kinds)).astype(np.int64)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), level, np.int32)), pa.array(kinds.view(np.int64)), pa.array(add(weight * bad)), pa.array(add(weight)), pa.array(add(bad))], names=["level", "token", "toxic", "total", "docs"])


def token_counts(train: DataFrame) -> DataFrame:
    """(level, token, toxic, total, toxic docs) over all training rows (text, toxic)."""
    found = train.select("text", "toxic").mapInArrow(_count, "level int, token long, toxic long, total long, docs long")
    return found.groupBy("level", "token").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"), F.sum("docs").alias("docs"))


class Model:
    """Kept tokens (sorted hashes by level) and their toxic and total counts, from columns (level, token, toxic, total)."""

    def __init__(self, kept: pd.DataFrame, toxic: int, total: int, prior: float = PRIOR, drift: float = DRIFT):
        self.prior, self.drift = prior, drift
        self.base = (toxic + 0.5) / (total + 1)
        self.tables = {}
        for level in (*PREFIXES, 0):
            own = kept[kept["level"] == level].sort_values("token")
            self.tables[level] = own["token"].to_numpy(np.int64), own["toxic"].to_numpy(float), own["total"].to_numpy(float)

    def score(self, words: Words) -> np.ndarray:
        """Log-odds over the overall rate minus the drift, by word."""
        codes, kinds, first = _unique(words.hashes)
        length = words.ends - words.starts
        rate = np.full(len(kinds), self.base)
        for level in (*PREFIXES, 0):
            keys, toxic, total = self.tables[level]
            if not len(keys):
                continue
            at = np.arange(len(kinds)) if level == 0 else np.flatnonzero(length[first] > level)
            w = first[at]
            h = (words.hashes[w] if level == 0 else words.spans(words.starts[w], words.starts[w] + level)).view(np.int64)
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            at, i = at[hit], i[hit]
            # bounded, or a frequent token that only toxic texts have would come to infinite odds
            rate[at] = np.minimum((toxic[i] + self.prior * rate[at]) / (total[i] + self.prior), MOST_RATE)
        odds = np.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - self.drift
        return odds[codes]


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, kinds = pd.factorize(h)
    first = np.zeros(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, kinds, first


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Only positive scores can begin or end a segment, so the scan goes over
    those; the negative scores between two of them are one gap from the running
    sum. A stack of candidates is merged where the cumulative sums allow it.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # start, end, sum before start, sum at end, nearest earlier with a smaller left sum
    for i in up.tolist():
        left, right = float(sums[i]), float(sums[i + 1])
        start = i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, i + 1, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1 if not stack else _back(stack, left)
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _back(stack: list[list], left: float) -> int:
    j = len(stack) - 1
    while j >= 0 and stack[j][2] >= left:
        j = stack[j][4]
    return j


SEGMENTS = "n_words long, best double, segments array<struct<start:int,end:int,score:double>>"


def _scan(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (id, text) the number of words and the segments in words."""
    m = model.value
    for part in chunks(batches, "text"):
        words = Words(part.column(1), NON_ALNUM)
        s = m.score(words) if len(words) else np.zeros(0)
        n, best, segs = [], [], []
        of = words.of.tolist()
        for d in range(part.num_rows):
            found = maximal_segments(s[of[d] : of[d + 1]])
            n.append(of[d + 1] - of[d])
            best.append(max((x[2] for x in found), default=0.0))
            segs.append([{"start": a, "end": b, "score": float(x)} for a, b, x in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(segs, kind)], names=["doc_id", "n_words", "best", "segments"])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, best, segments) of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scan(held, it), f"doc_id long, {SEGMENTS}")


def fit_gumbel(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """lambda and K of P(M > x) = 1 - exp(-K n e^(-lambda x)), by moments of the positive maxima."""
    on = best > 0
    if on.sum() < 10 or np.std(best[on]) < 1e-6:
        return 1.0, 0.1
    lam = math.pi / (math.sqrt(6) * float(np.std(best[on])))
    lam = min(max(lam, 0.05), 5.0)
    location = lam * float(np.mean(best[on])) - 0.5772
    return lam, math.exp(location) / max(1.0, float(np.mean(words[on]))) * float(on.mean())


def with_evidence(found: DataFrame, lam: float, k: float) -> DataFrame:
    """Adds ``norm`` (ln of K n + 1), ``one`` (normalised best score) and ``sum`` (log of the significant sum)."""
    found = found.withColumn("norm", F.log(F.lit(k) * F.greatest("n_words", F.lit(1)) + 1))
    total = F.expr(f"aggregate(segments, 0D, (t, s) -> t + greatest(0D, {lam!r}D * s.score - norm))")
    return found.withColumn("one", F.lit(lam) * F.col("best") - F.col("norm")).withColumn("sum", F.log1p(total))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) of a two-class logistic fit; an error if it does not converge.

    The inputs are standardised for the fit, so the penalty on the weights means
    the same for each of them; a Newton step is halved until the penalised loss
    falls, which a convex loss allows at every point but the minimum.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda w: float(np.logaddexp(0.0, -sign * (z @ w)).sum() + 0.5 * (penalty * w * w).sum())
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (p - y) + penalty * w
        if np.abs(gradient).max() < 1e-6 * max(len(x), 1):
            break
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while size > 1e-9 and not loss(w - size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        w = w - size * step
        now = loss(w)
    else:
        raise ArithmeticError("the logistic calibration did not converge")
    w[1:] /= scale
    w[0] -= float(w[1:] @ mean)
    return w


class Fitted:
    """Everything that scoring needs: token model, extreme-value and logistic parameters."""

    def __init__(self, model: Model, lam: float, k: float, weights: np.ndarray):
        self.model, self.lam, self.k, self.weights = model, lam, k, weights


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Fitted | None:
    """Learns from labelled rows outside the held-out fold; None without both classes."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(folds=folds)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = cut(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(marks), "doc_id")
    counts = cut(token_counts(train))
    sums = counts.where("level = 0").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total")).first()
    toxic, total = sums["toxic"] or 0, sums["total"] or 0
    if not 0 < toxic < total:
        return None
    base = toxic / total
    z = (F.col("toxic") - F.col("total") * base) / F.sqrt(F.col("total") * base * (1 - base))
    model = Model(fetch(counts.where((F.col("docs") >= MIN_TOXIC) & (z >= MIN_Z)).select("level", "token", "toxic", "total")), toxic, total)
    drop(counts)
    seen = scan(train, model).join(F.broadcast(marks), "doc_id").select("n_words", "best", "toxic", F.expr("transform(segments, s -> s.score)").alias("scores"))
    seen = cut(seen.orderBy(F.xxhash64("n_words", "best", "toxic")).limit(LABELLED_ROWS))
    got = fetch(seen.select("n_words", "best", "toxic"))
    y, words, best = got["toxic"].to_numpy(float), got["n_words"].to_numpy(float), got["best"].to_numpy(float)
    lam, k = fit_gumbel(best[y == 0], words[y == 0])
    got = fetch(with_evidence(seen.withColumn("segments", F.expr("transform(scores, s -> named_struct('score', s))")), lam, k).select("one", "sum", "toxic"))
    drop(seen)
    y = got["toxic"].to_numpy(float)
    a, b = got["one"].to_numpy(float), got["sum"].to_numpy(float)
    return Fitted(model, lam, k, fit_logistic(np.column_stack([a, b]), y))


def score(docs: DataFrame, fitted: Fitted | None, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, n_segments, best_start, best_end) for every document."""
    own = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    if fitted is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("long").alias("n_words"), F.lit(0).alias("n_segments"), F.lit(None).cast("int").alias("best_start"), F.lit(None).cast("int").alias("best_end"))
    lam, k, w = fitted.lam, fitted.k, [float(x) for x in fitted.weights]
    found = scan(docs, fitted.model)
    found = with_evidence(found, lam, k)
    logit = F.lit(w[0]) + F.lit(w[1]) * F.col("one") + F.lit(w[2]) * F.col("sum")
    found = found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    top = F.expr("array_max(transform(segments, s -> struct(s.score, s.start, s.end)))")
    return found.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", F.expr(f"size(filter(segments, s -> {lam!r}D * s.score > norm))").alias("n_segments"), top["start"].alias("best_start"), top["end"].alias("best_end"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, all columns kept, texts not shuffled.

    Rows are judged one by one in the scan of the texts, so documents with one
    id are judged apart.
    """
    fitted = fit(docs, labels, folds)
    if fitted is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(fitted)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for part in chunks(batches, "text"):
            words = Words(part.column(at), NON_ALNUM)
            s = f.model.score(words) if len(words) else np.zeros(0)
            of, keep = words.of.tolist(), []
            for d in range(part.num_rows):
                found = [x[2] for x in maximal_segments(s[of[d] : of[d + 1]])]
                norm = math.log(f.k * max(of[d + 1] - of[d], 1) + 1)
                one = f.lam * max(found, default=0.0) - norm
                total = math.log1p(sum(max(0.0, f.lam * x - norm) for x in found))
                keep.append(bool(f.weights[0] + f.weights[1] * one + f.weights[2] * total < 0))
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
