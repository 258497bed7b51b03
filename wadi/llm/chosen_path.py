"""Near-duplicate detection by a chosen-path set similarity join.

A document is the set of its 5-word shingles (``textcore.shingles``). Documents
with equal sets form one class; one of each class goes on. ``TREES`` independent
trees branch them: a node picks some of the ``COORDS`` minwise tokens by a hash
of its path, and a document goes to the child of the value that it has there. The
roots pick two tokens each, no token twice, so documents of likeness s part in all
trees with probability (1 - s) ** (2 * TREES). A node of at most ``SMALL`` documents
is compared exhaustively, a larger one branches further: by two tokens on the first
``WIDE`` levels, then by 1 / s on average, which keeps like documents together in as
many nodes while unlike ones part, and work does not grow with the depth.

Before a node is compared or branched, its first document is a centre: every
document is held against the likest centre of its nodes, on full sets. What a document
is linked with, or the document itself, is its label, and a node whose documents all
have one label has nothing left to tell and goes. A large group of near copies
comes down to few labels by links to centres, as many as documents.

Nodes are compared by sketches (a byte of each minwise value): documents of unlike
labels whose sketches agree in at least ``least_agreement`` places are candidates,
far below the likeness asked for. The groups that candidates form go on as sets of
their own, and are compared exactly on full sets of 64-bit shingles. Only texts of
candidates are moved; a bitmap of bounded size tells the scan of the texts which.

A node ``DEPTH`` deep that is still large and has several labels is cut into blocks
of ``SMALL`` / 2 and every two blocks are compared by sketches, exactly as whole. From
compared groups only a spanning forest of the true links goes out.

Defined results: null and empty texts have empty sets and stand alone; a null id
gets a row of its own with a null component; rows that repeat an id count as
one document of all their links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.components import components
from wadi.llm.ids import texts_of
from wadi.llm.storage import cut, drop
from wadi.llm.textcore import Words, chunks, mix, release, shingles

TREES, COORDS, SMALL, DEPTH, WIDE = 3, 64, 4096, 24, 3
#: Documents that are held against one copy of a centre.
BLOCK = 256
LIKENESS = Fraction(85, 100)
_MULTIPLIERS = np.random.default_rng(7121).integers(1, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(likeness: Fraction) -> int:
    """Places in which sketches of like documents agree but for one in some millions: five deviations below the mean."""
    s = float(likeness)
    return math.floor(COORDS * s - 5 * math.sqrt(COORDS * s * (1 - s)))


def minwise(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``COORDS`` minwise 32-bit values of each set; empty sets have all ones."""
    out = np.full((len(offs) - 1, COORDS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        at = offs[:-1][full]
        for j in range(COORDS):
            out[full, j] = np.minimum.reduceat((values * _MULTIPLIERS[j] >> np.uint64(32)).astype(np.uint32), at)
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(matrix.ravel()))


def _signatures(batches: Iterator[pa.RecordBatch], k: int, trees: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        values, offs = shingles(Words(part.column(1)), k)
        n = np.diff(offs)
        sums = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(mix(values ^ np.uint64(salt)), out=total[1:])
            sums.append(mix((total[offs[1:]] - total[offs[:-1]]) + n.astype(np.uint64)).view(np.int64))
        mh = minwise(values, offs)
        at = np.arange(2 * trees) % COORDS
        roots = mix(mh[:, at].astype(np.uint64) + (np.arange(2 * trees, dtype=np.uint64) << np.uint64(32))).view(np.int64)
        sketch = pa.array([r.tobytes() for r in (mh & np.uint32(255)).astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), _lists(roots), sketch], names=["doc_id", "n_shingles", "d1", "d2", "roots", "sketch"])


def signatures(docs: DataFrame, k: int = 5, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, roots, sketch): set size, 128-bit digest, keys of the children of the roots, a byte of each minwise value."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _signatures(it, k, trees), "doc_id long, n_shingles long, d1 long, d2 long, roots array<bigint>, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, centre, agree) of (rep, centre, sketch, centre's sketch)."""
    for batch in batches:
        if batch.num_rows:
            agree = (_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree, pa.int32())], names=["rep", "centre", "agree"])


def _branch(batches: Iterator[pa.RecordBatch], second: float) -> Iterator[pa.RecordBatch]:
    """(key, rep, label) of the children of (key, rep, label, sketch); nodes make the second pick with the given chance, by their key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sketch = batch.column(0).to_numpy().view(np.uint64), _sketches(batch.column(3))
        h = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        first = h % np.uint64(COORDS)
        other = (first + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(COORDS - 1)) % np.uint64(COORDS)
        chance = (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        for pick, on in ((first, np.arange(len(keys))), (other, np.flatnonzero(chance < second))):
            p = pick[on]
            key = mix(keys[on] ^ mix(sketch[on, p.astype(np.int64)].astype(np.uint64) + (p << np.uint64(32))))
            at = pa.array(on)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], names=["key", "rep", "label"])


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def candidates(reps: np.ndarray, labels: np.ndarray, sides: np.ndarray, sketch: np.ndarray, least: int) -> list[np.ndarray]:
    """Groups of documents of one node that candidate pairs join: unlike labels, agreeing sketches.

    With sides other than 0, pairs are of unlike sides.
    """
    parent, on = list(range(len(reps))), np.zeros(len(reps), bool)
    cross = bool(sides.any())
    for i in range(len(reps) - 1):
        near = ((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least) & (labels[i + 1 :] != labels[i])
        if cross:
            near &= sides[i + 1 :] != sides[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            on[i] = on[j] = True
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[a] = b
    groups: dict[int, list[int]] = {}
    for i in np.flatnonzero(on).tolist():
        groups.setdefault(_root(parent, i), []).append(i)
    return [np.sort(reps[g]) for g in groups.values()]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns (rep, label, side, sketch) of one node after another, from rows (key, part, rep, label, side, sketch) sorted by (key, part)."""
    held: list[list[np.ndarray]] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cols = [batch.column(i).to_numpy() for i in (2, 3, 4)] + [_sketches(batch.column(5))]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if (key[a], part[a]) != at and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = key[a], part[a]
            held.append([c[a:b] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(team, doc_id): the groups of candidates of all nodes, each named by its members, so that equal ones are one."""
    seen: set[int] = set()
    out: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        names = [int(np.bitwise_xor.reduce(mix(g.view(np.uint64))) + np.uint64(len(g)) & np.uint64(0x7FFFFFFFFFFFFFFF)) for g in out]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), [len(g) for g in out])), pa.array(np.concatenate(out))], names=["team", "doc_id"])

    for rep, label, side, sketch in _nodes(batches):
        for g in candidates(rep, label, side, sketch, least):
            g = np.unique(g)
            h = hash(g.tobytes())
            if h not in seen:
                seen.add(h)
                out.append(g)
        if len(seen) > 1_000_000:
            seen.clear()
        if sum(map(len, out)) > 50_000:
            yield rows()
            out = []
    if out:
        yield rows()
    release()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def like(a: np.ndarray, b: np.ndarray, likeness: Fraction) -> bool:
    both = overlap(a, b)
    return both > 0 and likeness.denominator * both >= likeness.numerator * (len(a) + len(b) - both)


def _stars(batches: Iterator[pa.RecordBatch], likeness: Fraction, k: int) -> Iterator[pa.RecordBatch]:
    """True links (a, b) from rows (centre, block, member, doc_id, text), those of the centre first in each block."""
    at, centres = None, []
    for part in chunks(batches, "text"):
        values, offs = shingles(Words(part.column(4)), k)
        out = []
        for i, row in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True)):
            if row[:2] != at:
                at, centres = row[:2], []
            own = values[offs[i] : offs[i + 1]]
            if not row[2]:
                centres.append(own.copy())
            elif any(like(own, c, likeness) for c in centres):
                out.append((row[3], row[0]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def star_links(docs: DataFrame, pairs: DataFrame, likeness: Fraction, k: int) -> DataFrame:
    """The true links among ``pairs`` (rep, centre); a centre's documents are dealt to blocks, each with its text once."""
    pairs = cut(pairs)
    blocks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = cut(pairs.join(blocks, "centre").select("centre", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.col("rep").alias("doc_id")))
    asked = dealt.select("centre", "block", F.lit(1).alias("member"), "doc_id").union(dealt.select("centre", "block").distinct().select("centre", "block", F.lit(0), F.col("centre")))
    ids = cut(asked.select("doc_id").distinct())
    sent = asked.join(texts_of(docs, ids), "doc_id").select("centre", "block", "member", "doc_id", "text")
    links = cut(sent.repartition("centre", "block").sortWithinPartitions("centre", "block", "member").mapInArrow(lambda it: _stars(it, likeness, k), "a long, b long"))
    drop(pairs, dealt, ids)
    return links


def forest(reps: list[int], sets: list[np.ndarray], likeness: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links within one group, from exact intersections; pairs that are joined already are passed over."""
    sizes, parent, out = np.array([len(x) for x in sets]), list(range(len(reps))), []
    for i in range(len(reps) - 1):
        own = _root(parent, i)
        left = [j for j in range(i + 1, len(reps)) if _root(parent, j) != own]
        if not left:
            continue
        flat = np.concatenate([sets[j] for j in left])
        starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
        hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
        both = np.add.reduceat(hit, starts, dtype=np.int64)
        for x in np.flatnonzero(likeness.denominator * both >= likeness.numerator * (sizes[i] + sizes[left] - both)).tolist():
            j = left[x]
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[a] = b
                out.append((int(min(reps[i], reps[j])), int(max(reps[i], reps[j]))))
    return out


def _teams(batches: Iterator[pa.RecordBatch], likeness: Fraction, k: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (team, doc_id, text) sorted by team; the sets of one team in memory at a time."""
    at, ids, sets, out = None, [], [], []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    for part in chunks(batches, "text"):
        values, offs = shingles(Words(part.column(2)), k)
        for i, (team, doc_id) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
            if team != at:
                out += forest(ids, sets, likeness) if len(ids) > 1 else []
                at, ids, sets = team, [], []
            if offs[i + 1] > offs[i]:
                ids.append(doc_id)
                sets.append(values[offs[i] : offs[i + 1]].copy())
        if len(out) > 10_000:
            yield rows()
            out = []
    out += forest(ids, sets, likeness) if len(ids) > 1 else []
    if out:
        yield rows()


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one label, with the node's size and its first document."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
    return cut(rows.join(sizes.where("low < high").select("key", "n", "first"), "key"))


def _relabelled(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` with the centre that a document is linked with, or that centre's own centre, as its label."""
    of = stars.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("c"))
    further = of.select(F.col("rep").alias("c"), F.col("c").alias("cc"))
    label = of.join(further, "c", "left").select("rep", F.coalesce("cc", "c").alias("to"))
    label = label.union(of.select("c").distinct().join(of.select(F.col("rep").alias("c")), "c", "left_anti").select("c", "c"))
    out = _mixed(rows.select("key", "rep").join(label, "rep", "left").select("key", "rep", F.coalesce("to", "rep").alias("label")))
    drop(rows)
    return out


def _centres(rows: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(rep, centre): for every document the likest of the first documents of its nodes."""
    asked = rows.where("rep <> first").select("rep", F.col("first").alias("centre")).distinct()
    both = asked.join(reps.select("rep", "sketch"), "rep").join(reps.select(F.col("rep").alias("centre"), F.col("sketch").alias("other")), "centre")
    agree = both.select("rep", "centre", "sketch", "other").mapInArrow(_agreement, "rep long, centre long, agree int").where(F.col("agree") >= least)
    return agree.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("centre")).alias("c"))).alias("m")).select("rep", (-F.col("m.c")).alias("centre"))


def teams(rows: DataFrame, reps: DataFrame, likeness: Fraction, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(team, doc_id): groups of candidates of all nodes, from the mixed nodes below the roots; large ones are branched."""
    least = least_agreement(likeness)
    seen = []
    for level in range(1, depth + 1):
        with_sketch = lambda df: df.join(reps.select("rep", "sketch"), "rep")
        ready = with_sketch(rows.where(F.col("n") <= small)).select("key", F.lit(0).cast("long").alias("part"), "rep", "label", F.lit(0).alias("side"), "sketch")
        big = rows.where(F.col("n") > small)
        more = big.limit(1).count() > 0
        if more and level == depth:
            count = F.ceil(F.col("n") / (small // 2)).cast("long")
            own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("count"))
            # a member meets block x in part (low, high) of its own block and x; the side tells the blocks apart
            met = with_sketch(big).withColumn("count", count).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
            low, high = F.least("own", "other"), F.greatest("own", "other")
            ready = ready.union(met.select("key", (low * F.col("count") + high + 1).alias("part"), "rep", "label", F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2).alias("side"), "sketch"))
        seen.append(cut(ready.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda it: _candidates(it, least), "team long, doc_id long")))
        if not more or level == depth:
            break
        second = 1.0 if level < WIDE else float(1 / likeness) - 1
        rows = _mixed(with_sketch(big).select("key", "rep", "label", "sketch").mapInArrow(lambda it, s=second: _branch(it, s), "key long, rep long, label long"))
    out = seen[0]
    for r in seen[1:]:
        out = out.union(r)
    return out.distinct()


def near_duplicates(docs: DataFrame, likeness: Fraction = LIKENESS, k: int = 5, trees: int = TREES, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...)."""
    sig = cut(signatures(docs, k, trees))
    named = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = cut(named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "roots", "sketch")).alias("m")).select("d1", "d2", F.col("m.doc_id").alias("rep"), "m.roots", "m.sketch"))
    # rows that repeat an id are one document: all its classes are linked
    classes = cut(named.select("doc_id", "d1", "d2").distinct().join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep"))
    several = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    links = [cut(classes.join(several, "doc_id").select("a", F.col("rep").alias("b")))]
    rows = _mixed(reps.select(F.explode("roots").alias("key"), "rep", F.col("rep").alias("label")))
    links.append(star_links(docs, _centres(rows, reps, least_agreement(likeness)), likeness, k))
    rows = _relabelled(rows, links[1])
    found = cut(teams(rows, reps, likeness, small, depth))
    ids = cut(found.select("doc_id").distinct())
    sent = found.join(texts_of(docs, ids), "doc_id").select("team", "doc_id", "text")
    links.append(cut(sent.repartition("team").sortWithinPartitions("team").mapInArrow(lambda it: _teams(it, likeness, k), "a long, b long")))
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    joined = components(every)
    drop(rows, found, ids, *links)
    of_id = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    own = cut(of_id.groupBy("doc_id").agg(F.min("component").alias("component")))
    out = sig.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
classes AS (SELECT doc_id, n, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x)) AS d FROM items GROUP BY doc_id, n),
reps AS (SELECT d, min(doc_id) AS rep FROM classes GROUP BY d),
member AS (SELECT i.doc_id AS rep, i.n, i.x FROM items i JOIN reps r ON r.rep = i.doc_id),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM member a JOIN member b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT rep, rep FROM reps UNION SELECT r.node, e.b FROM reach r JOIN linked e ON e.a = r.other),
least_of AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.doc_id = s.doc_id LEFT JOIN reps r ON r.d = c.d LEFT JOIN least_of l ON l.node = r.rep
"""
