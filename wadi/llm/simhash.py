"""SimHash near-duplicate detection by an inverted index of byte positions with count filtering.

A text's fingerprint has a bit set if more than half of the XXH64 hashes of its
4-word shingles (repeats included) have it set. Fingerprints are linked if at most
four of their 64 bits differ. Four bits lie in at most four of the eight bytes, so
linked fingerprints share at least four bytes, value and position: the guaranteed
minimum of matches.

The index lists fingerprints under a few positions and the bytes there. The sets of
positions (``POSITIONS``) are such that any four positions contain one of them, so a
linked pair meets in a list; sets of two, three or four positions make 7, 20 or 70
entries for each fingerprint, and lists that are 256 times shorter for each step. The
width follows from the number of fingerprints (``width_for``) and never changes the
result. Within a list the shared bytes of a pair are tallied over all eight positions,
pairs with four or more are retained, and verified by counting the bits that differ.

A list goes to one task; one of more than ``SMALL`` entries is cut into blocks, and
every two blocks meet in a task of their own, exactly as whole. Pairs are not written:
a task joins what is linked in its list and writes each entry with the least entry of
its piece. Pieces of all lists are joined by contraction (``components``). Equal
fingerprints are one entry, named by the least id.

Defined results: null and empty texts have the fingerprint zero, which links like any
other; with fewer words than a shingle the whole sequence is one; a row without an id has
its fingerprint, a null component and links with nothing; rows that repeat an id are one
document with the links of all of them; repeated texts are in one component. No rows, no
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.components import components
from wadi.llm.storage import cut, drop
from wadi.llm.textcore import chunks, release

SHINGLE, SEED = 4, 42
#: Fingerprints link at this many differing bits; least number of bytes that they share then.
BITS, SHARED = 4, 4
#: Entries of a list that one task compares, at most.
SMALL = 4096
#: Hashes whose bits are counted at a time.
STEP = 1 << 16


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any four of the eight positions contain one.

    Positions fall into the groups 012, 345 and 67. Of four positions two share a
    group; and three of them are in one group, or two in a group and one in the next.
    """
    if width == 4:
        return list(combinations(range(8), 4))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for g in groups for c in combinations(g, width)]
    if width == 3:
        out += [tuple(sorted((*c, x))) for i, g in enumerate(groups) for c in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return out


POSITIONS = {w: position_sets(w) for w in (2, 3, 4)}


def width_for(n: int) -> int:
    """Positions of an index entry, so that lists of ``n`` spread fingerprints have some hundreds of entries."""
    return 2 if n <= 1 << 25 else 3 if n <= 1 << 33 else 4


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        some = hashes[at : at + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            fps = np.array([fingerprint(t.as_py(), k) for t in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _entries(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(list, fp) for each set of positions; a list's key holds the set's number above the bytes."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        own = np.ascontiguousarray(fp, "<i8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for number, at in enumerate(POSITIONS[width]):
            key = np.full(len(fp), number, np.int64)
            for p in at:
                key = key << 8 | own[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["list", "fp"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints share ``SHARED`` positional bytes or more, and, of those, differ in ``BITS`` bits or fewer."""
    diff = a ^ b
    tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    kept = np.flatnonzero(tally >= SHARED)
    out = np.zeros(len(a), bool)
    out[kept] = np.bitwise_count(diff[kept]) <= BITS
    return out


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the pieces of entries a and b in ``label``, in place; a label is the place of a piece's first entry."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def pieces(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For sorted list keys and their fingerprints: the place of the first entry of each one's piece.

    Entry i is compared with entry i + 1, i + 2, ... of its list, all lists at a time;
    pairs that are joined already are passed over.
    """
    n = len(keys)
    label = np.arange(n)
    ends = np.searchsorted(keys, keys, "right")
    active, shift = np.flatnonzero(ends > np.arange(n) + 1), 1
    while len(active):
        apart = active[label[active] != label[active + shift]]
        hit = apart[near(fps[apart], fps[apart + shift])]
        if len(hit):
            _join(label, hit, hit + shift)
        shift += 1
        active = active[ends[active] > active + shift]
    return label


def _whole_lists(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) of some whole lists at a time, from rows (list, part, fp) sorted by list and part."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, number = 0, 0

    def keyed(lists: np.ndarray, parts: np.ndarray) -> np.ndarray:
        new = (lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1])
        return np.concatenate([[0], np.cumsum(new)])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        size += batch.num_rows
        if size >= least:
            lists, parts, fps = (np.concatenate(c) for c in zip(*held, strict=True))
            keys = keyed(lists, parts)
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield keys[:whole], fps[:whole]
            held, size = [(lists[whole:], parts[whole:], fps[whole:])], len(lists) - whole
    if size:
        lists, parts, fps = (np.concatenate(c) for c in zip(*held, strict=True))
        yield keyed(lists, parts), fps


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every entry that is not the first of its piece, with the first; one that the task wrote just now is not repeated."""
    seen = np.zeros((0, 2), np.int64)
    for keys, fps in _whole_lists(batches):
        label = pieces(keys, np.ascontiguousarray(fps).view(np.uint64))
        on = np.flatnonzero(label != np.arange(len(label)))
        if len(on):
            seen = np.unique(np.stack([fps[label[on]], fps[on]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0].copy()), pa.array(seen[:, 1].copy())], names=["a", "b"])
    release()


def links(fps: DataFrame, width: int | None = None, small: int = SMALL) -> DataFrame:
    """(a, b): links between distinct fingerprints (one column, fp long) that join what is reachable at ``BITS`` differing bits or fewer."""
    width = width or width_for(fps.count())
    rows = cut(fps.mapInArrow(lambda it: _entries(it, width), "list long, fp long"))
    # blocks are half as long, so that two of them are no more than a small list
    sizes = rows.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "list").withColumn("blocks", F.when(F.col("n") > small, F.ceil(2 * F.col("n") / small)).otherwise(1).cast("long"))
    whole = rows.where("blocks = 1").select("list", F.lit(0).cast("long").alias("part"), "fp")
    long = rows.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a block meets itself along with each other one
    met = long.where("own <> other").select("list", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"), "fp")
    dealt = whole.union(met).repartition("list", "part").sortWithinPartitions("list", "part", "fp")
    out = cut(dealt.mapInArrow(_stars, "a long, b long"))
    drop(rows)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, width: int | None = None, small: int = SMALL) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the least id that can be reached."""
    own = cut(fingerprints(docs, id_col, text_col, k))
    named = own.where(F.col("doc_id").isNotNull())
    reps = cut(named.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = links(reps.select("fp"), width, small)
    a, b = reps.toDF("a", "ra"), reps.toDF("b", "rb")
    # an id with several fingerprints joins them
    edges = found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(named.join(reps, "fp").select("doc_id", "rep").where("doc_id <> rep"))
    joined = components(edges)
    of_id = joined.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id")
    out = own.join(of_id, "doc_id", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    drop(found)
    return out


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
