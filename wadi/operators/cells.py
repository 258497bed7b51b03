"""Vector search by parts: exact between blocks, or in the cells near a query.

Both deal vectors to parts of bounded size; a task holds the vectors of one part, reads
the queries that were sent there, and passes on the best k of each. Nothing goes through
the driver but a bounded sample and the sizes of the cells.

``nearest`` and ``neighbours`` are exact: every query (or block of vectors) meets every part, by
one product of matrices; only the best go through it one by one. ``Cells`` is an index: centres
are fitted to at most ``SAMPLE`` vectors (those of least hash), every vector belongs to
the nearest centre, and a query visits as many of the nearest cells as the sample needs
for the recall asked for. A cell of more than ``PART`` vectors is several parts, so many
equal vectors are dealt like others. Scores are inner products, rounded to six digits;
equal scores go by id. Null vectors are in no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, PART, ROUNDS = 1 << 16, 4096, 8192, 8
#: Scores that a task holds at once (16 MB); scores this near the last one go on, as they are compared after rounding.
SCORES, MARGIN = 1 << 21, 2e-6
#: Stands for a null number inside tasks.
NONE = -(1 << 63)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, zeros for null ones, and which are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), len(flat) // max(1, int(there.sum()))), flat.dtype)
    out[there] = flat.reshape(-1, out.shape[1])
    return out, there


def _wide(parts: list[np.ndarray], unit: bool) -> np.ndarray:
    """One matrix in double, of rows of length one if ``unit``; those without length stay as they are."""
    d = max(x.shape[1] for x in parts)
    v = np.concatenate([x if x.shape[1] == d else np.zeros((len(x), d)) for x in parts]).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if unit else v


def _chosen(scores: np.ndarray, k: int, least: float | None, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, and of those within its margin; none of -inf."""
    m, n = scores.shape
    floor = np.full(m, -np.inf)
    if n > k:
        step = max(1, n // (16 * k))
        # the k-th of the maxima of groups is at most the k-th of all
        tops = scores[:, : n // step * step].reshape(m, step, n // step).max(axis=1)
        floor = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    if least is not None:
        floor = np.maximum(floor, least)
    floor = np.maximum(floor - margin, np.finfo(scores.dtype).min).astype(scores.dtype)
    return np.divmod(np.flatnonzero(scores >= floor[:, None]), n)


def _dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in order, so that they are the same in every task."""
    out = np.zeros(len(q))
    for i in range(v.shape[1]):
        out += q[:, i] * v[:, i]
    return out


class _Part:
    """The vectors of one part, in the order of strata and ids, and the queries' best of them.

    Of equal vectors of a stratum only the k + 1 least ids can be among the best, so copies do not add up.
    """

    def __init__(self, held: list[tuple], k: int, strata: bool, unit: bool):
        kept, ids, there = (np.concatenate([x[i] for x in held]) for i in range(3))
        v = _wide([x[3] for x in held], False)
        stratum = kept if strata else np.zeros(len(ids), np.int64)
        equal = np.unique(v.view(f"V{8 * v.shape[1]}").ravel(), return_inverse=True)[1] if v.shape[1] else np.zeros(len(ids), np.int64)
        by = np.lexsort((ids, equal, there, stratum))
        new = np.concatenate([[True], (np.diff(equal[by]) != 0) | (np.diff(there[by].astype(int)) != 0) | (np.diff(stratum[by]) != 0)])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        first = by[place <= k]
        order = first[np.lexsort((ids[first], stratum[first]))]
        self.kept, self.ids, self.there, self.v = kept[order], ids[order], there[order], _wide([v[order]], unit)
        cuts = (np.flatnonzero(np.diff(self.kept)) + 1).tolist() if strata else []
        self.slices = list(zip([0, *cuts], [*cuts, len(order)], strict=True))
        self.by_id = np.argsort(self.ids, kind="stable")
        # floats are multiplied as floats first; the best are then added up in double
        self.first = self.v.astype(held[0][3].dtype)
        self.norm, self.error = np.sqrt((self.v**2).sum(1).max()), (self.v.shape[1] + 8) * float(np.finfo(self.first.dtype).eps)
        self.unit = unit

    def best(self, ids: np.ndarray, there: np.ndarray, q: np.ndarray, k: int, least: float | None, others: bool) -> tuple[np.ndarray, ...]:
        """(query, place, score) arrays; the score of a null vector is null (nan) and comes last."""
        q = _wide([q], self.unit)
        if q.shape[1] != self.v.shape[1]:  # all null on one side
            q, there = np.zeros((len(q), self.v.shape[1])), np.zeros(len(q), bool)
        scores = q.astype(self.first.dtype) @ self.first.T
        margin = MARGIN + 2 * self.error * self.norm * np.sqrt((q**2).sum(1))
        if not (self.there.all() and there.all()):
            scores[:, ~self.there] = scores[~there] = -np.inf
        if others:
            first, last = (np.searchsorted(self.ids[self.by_id], ids, side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first):
                scores[i, self.by_id[first[i] : last[i]]] = -np.inf
        found = []
        for a, b in self.slices:
            rows, columns = _chosen(scores[:, a:b], k, least, margin)
            found.append((rows, columns + a, _dots(q[rows], self.v[columns + a])))
            if least is None and not (self.there[a:b].all() and there.all()):
                lacking = np.bincount(rows, minlength=len(q)) < k
                for i in np.flatnonzero(lacking):
                    nulls = np.flatnonzero(~(self.there[a:b] & there[i]) & ~(others & (self.ids[a:b] == ids[i])))[:k] + a
                    found.append((np.full(len(nulls), i), nulls, np.full(len(nulls), np.nan)))
        return tuple(np.concatenate([x[i] for x in found]) for i in range(3))


def _best(batches: Iterator[pa.RecordBatch], k: int, least: float | None, others: bool, strata: bool, unit: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, kept, score): the best k in each part, and what rounding might put among them.

    From rows (cell, part, kind, kept, id, v), of a part its vectors (0) before its queries (1).
    """
    at, held, own_part = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
        kept, own = batch.column(3).fill_null(NONE).to_numpy(), batch.column(4).to_numpy()
        v, there = _filled(batch.column(5))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            if (cell[a], part[a]) != at:
                at, held, own_part = (cell[a], part[a]), [], None
            if kind[a] == 0:
                held.append((kept[a:b], own[a:b], there[a:b], v[a:b]))
                continue
            if own_part is None:
                if not held:
                    continue
                own_part, held = _Part(held, k, strata, unit), []
            step = max(1, SCORES // len(own_part.ids))
            for c in range(a, b, step):
                e = min(c + step, b)
                rows, columns, score = own_part.best(own[c:e], there[c:e], v[c:e], k, least, others)
                label = own_part.kept[columns]
                yield pa.RecordBatch.from_arrays([pa.array(own[c:e][rows]), pa.array(own_part.ids[columns]), pa.array(label, mask=label == NONE), pa.array(score, from_pandas=True)], names=["query_id", "vec_id", "kept", "score"])


def _meet(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, others: bool = False, strata: bool = False, unit: bool = False) -> DataFrame:
    """The best k of each query (and stratum) over all its parts, by score, then id; both are (cell, part, id, v), vectors may have ``kept``, a number that goes along."""
    kept = F.col("kept") if "kept" in vectors.columns else F.lit(None)
    both = vectors.select("cell", "part", F.lit(0).alias("kind"), kept.cast("long").alias("kept"), "id", "v").unionByName(queries.select("cell", "part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("kept"), "id", "v"))
    dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = dealt.mapInArrow(lambda it: _best(it, k, least, others, strata, unit), "query_id long, vec_id long, kept long, score double").withColumn("score", F.round("score", 6))
    found = found if least is None else found.where(F.col("score") >= least)
    w = Window.partitionBy("query_id", *(["kept"] if strata else [])).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _rows(vectors: DataFrame, id_col: str, v_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(v_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, kept: str | None = None, strata: bool = False, others: bool = False, part: int = PART * 2) -> DataFrame:
    """(query_id, vec_id, ``kept``, score, rank): the best k of (vec_id, v) for every (query_id, q), exactly.

    With ``strata`` k for each value of ``kept`` (a column of whole numbers), with ``others`` none of the query's id.
    Every part of the vectors reads all queries; a null vector's score is null and comes last.
    """
    kind = _kind(queries, "q", vectors, "v")
    parts = max(1, -(-vectors.count() // part))
    zero = F.lit(0).cast("long").alias("cell")
    held = vectors.select(zero, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.col("vec_id").cast("long").alias("id"), F.col("v").cast(kind).alias("v"), *([F.col(kept).cast("long").alias("kept")] if kept else []))
    asked = queries.select(zero, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("query_id").cast("long").alias("id"), F.col("q").cast(kind).alias("v"))
    found = _meet(held, asked, k, None, others, strata)
    return found.withColumn(kept, F.col("kept").cast(vectors.schema[kept].dataType)).drop("kept") if kept else found.drop("kept")


def _kind(queries: DataFrame, q: str, vectors: DataFrame, v: str) -> str:
    """Floats are sent as they are, all else as double; products are in double."""
    return "array<float>" if {queries.schema[q].dataType.simpleString(), vectors.schema[v].dataType.simpleString()} == {"array<float>"} else "array<double>"


def neighbours(vectors: DataFrame, least: float, k: int, part: int = PART * 4) -> DataFrame:
    """(id, other, score, rank): up to k others of cosine at least ``least`` of every vector (id, v), exactly."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast(_kind(vectors, "v", vectors, "v")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    blocks = max(1, -(-vectors.count() // part))
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    there = own.withColumn("other", every)
    held = there.select(F.col("block").alias("cell"), F.col("other").alias("part"), "id", "v")
    asked = there.select(F.col("other").alias("cell"), F.col("block").alias("part"), "id", "v")
    return _meet(held, asked, k, least, True, unit=True).select(F.col("query_id").alias("id"), F.col("vec_id").alias("other"), "score", "rank")


@dataclass
class Cells:
    """Centres of the cells, and how many of them a query visits."""

    centres: np.ndarray
    probes: int

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        distance = (self.centres**2).sum(1) - 2 * v @ self.centres.T
        return np.argsort(distance, axis=1, kind="stable")[:, :n]


def _fit_centres(v: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    centres = v[np.linspace(0, len(v) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = Cells(centres, 1).nearest(v, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        n = np.bincount(own, minlength=cells)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: DataFrame, recall: float = 0.95, k: int = 10, id_col: str = "vec_id", v_col: str = "v", sample: int = SAMPLE) -> Cells:
    """Cells for ``vectors``: about as many as the root of their number, and as many visits as find the k best of a hundred sampled vectors with ``recall``.

    The sample is sparser than the whole, which makes its neighbours further, so the visits err on the safe side.
    """
    rows = _rows(vectors, id_col, v_col)
    n = rows.count()
    if not n:
        return Cells(np.zeros((1, 1)), 1)
    held = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    v = np.array(held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(held.num_rows, -1)
    cells = max(1, min(MOST_CELLS, int(n**0.5), len(v)))
    index = Cells(_fit_centres(v, cells, ROUNDS), cells)
    own, asked = index.nearest(v, 1)[:, 0], v[:: max(1, len(v) // 100)]
    best = np.argsort(-(asked @ v.T), axis=1, kind="stable")[:, :k]
    order = index.nearest(asked, cells)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return index


def search(index: Cells, queries: DataFrame, vectors: DataFrame, k: int, part: int = PART) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of (vec_id, v) that the cells near (query_id, q) hold."""

    def cells_of(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    some = batch.slice(a, 1024)
                    near = index.nearest(_matrix(some.column(1)), n)
                    at = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), some.column(0).take(at), some.column(1).take(at)], names=["cell", "id", "v"])

        return run

    schema = "cell long, id long, v array<double>"
    held = _rows(vectors, "vec_id", "v").mapInArrow(cells_of(1), schema)
    asked = _rows(queries, "query_id", "q").mapInArrow(cells_of(index.probes), schema)
    # at most MOST_CELLS rows
    sizes = held.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part)).select("cell", "parts")
    sizes = F.broadcast(sizes)
    held = held.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "v")
    asked = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "v")
    return _meet(held, asked, k).drop("kept")
