"""Spelling variants by forward and backward minimal automata with perfect-hash word numbers.

Words are near if exactly one code point is inserted, deleted or replaced. Then one
half of a word stands unchanged in the other, as its start or as its end: an error in
the second half leaves the first ``len // 2`` code points, one in the first half leaves
the rest. So every word is looked for twice: in a forward automaton, the first half
exactly and the rest with one error, and in a backward one (over reversed words) the
second half exactly and the rest with one error. What the backward search finds with
an unchanged first half the forward search has found too, so it goes.

Words have at least ``LEAST`` code points, so halves have at least 3 and 4: words are
dealt to tasks by their first 3 code points for the forward search and by their last 4
for the backward one, both searches in one shuffle. A task takes some whole groups at
a time, builds their automaton (``automata.Automaton``) and looks up their words in it.
A group of more than ``SMALL`` code points is cut into blocks, and every two blocks meet
in a part of their own, exactly as whole. A part's output is a row for each word that
has near words there: their number, and the most frequent of them.

Counts are summed up in each task before the exchange, for all documents.

Defined results: a null text has no runs; a null id counts as the empty id in the hash;
repeated rows count each time; ties of forms go to the smallest in code-point order; a
form has ten times the occurrences, so chains of forms end. No words, no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.automata import Automaton, flat
from wadi.llm.storage import cut, drop
from wadi.llm.textcore import chunks, release

#: A run of which the hash is a multiple of this loses a code point.
EVERY = 31
#: Least code points and occurrences of a word, and how many times the word's occurrences its form has.
LEAST, OCCURRENCES, TIMES = 7, 2, 10
#: Code points of the words of one automaton.
SMALL = 1 << 19
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 17


def _runs(least: int) -> re.Pattern:
    """Maximal runs of at least so many letters, in lower-cased Latin-1."""
    return re.compile(rb"[a-z\xC0-\xFF]{%d,}" % least)


def runs_of(text: str | None, least: int = LEAST) -> list[bytes]:
    """Runs of at least ``least`` letters with A-Z lower-cased, in Latin-1: a byte is a code point."""
    return _runs(least).findall((text or "").encode("latin-1", "replace").lower())


def changed(run: bytes, doc: bytes, every: int = EVERY) -> bytes:
    """The run, or what is left of it without one code point, by the hash of document and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc))
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): all words of at least ``least`` code points with their occurrences in all rows."""

    def packed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in chunks(batches, "text"):
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                salt = f"{doc.as_py() or ''}:".encode()
                for r, n in Counter(runs_of(text.as_py(), least)).items():
                    word = changed(r, salt, every)
                    if len(word) >= least:
                        counts[word] += n
            if len(counts) > HELD:
                yield packed(counts)
                counts = Counter()
        yield packed(counts)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_numbers(words: list[bytes], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the words j that are near word i with an unchanged first half, or, backward, with a changed one."""
    turned = [w[::-1] for w in words] if backward else words
    order = np.array(sorted(range(len(words)), key=turned.__getitem__), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    half = lengths // 2
    i, number = Automaton([turned[k] for k in order.tolist()]).one_error(turned, lengths - half if backward else half)
    j = order[number]
    if backward:
        buf, offs, lengths = flat(words)
        same, d = np.arange(len(i)), 0
        alike = np.zeros(len(i), bool)
        while len(same):
            over = half[i[same]] == d
            alike[same[over]] = True
            same = same[~over & (lengths[j[same]] > d)]
            same = same[buf[offs[i[same]] + d] == buf[offs[j[same]] + d]]
            d += 1
        i, j = i[~alike], j[~alike]
    return i, j


def _lots(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[tuple[bool, list[str], np.ndarray, np.ndarray]]:
    """(backward, words, sides, counts) of some whole groups, or of one part of a group in blocks.

    From rows (key, part, side, word, n), sorted by key and part, all rows of a group in a row.
    """
    held: list[tuple] = []
    size, open_at = 0, 0

    def lot(rows: list[tuple]):
        return rows[0][0][0] == "b", [r[3] for r in rows], np.array([r[2] for r in rows]), np.array([r[4] for r in rows], np.int64)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and row[:2] != held[-1][:2]:
                alone = row[1] != 0 or held[-1][1] != 0 or row[0][0] != held[-1][0][0]
                if alone or size >= small:
                    yield lot(held)
                    held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield lot(held)


def _near(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """(word, near, n, form): how many near words each word has in its lot, and the most frequent of them."""
    for backward, words, sides, counts in _lots(batches, small):
        i, j = near_numbers([w.encode("latin-1") for w in words], backward)
        # in a part of two blocks only pairs across count; within a block they are found in its own part
        across = (sides[i] != sides[j]) | (sides[i] == 0)
        i, j = i[across], j[across]
        if len(i):
            rank = np.argsort(np.array(words, object), kind="stable")
            place = np.empty(len(words), np.int64)
            place[rank] = np.arange(len(words))
            best = np.lexsort((place[j], -counts[j], i))
            i, j = i[best], j[best]
            own, first, near = np.unique(i, return_index=True, return_counts=True)
            form = j[first]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in own]), pa.array(near), pa.array(counts[form]), pa.array([words[k] for k in form])], names=["word", "near", "n", "form"])
    release()


def near_words(words: DataFrame, least: int = LEAST, small: int = SMALL) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) that have near words among them; best is the most frequent one."""
    half = least // 2
    key = F.explode(F.array(F.concat(F.lit("f"), F.substring("word", 1, half)), F.concat(F.lit("b"), F.substring("word", half - least, least - half))))
    rows = words.select("word", "n", key.alias("key"))
    sizes = rows.groupBy("key").agg(F.sum(F.length("word")).alias("size"), F.count("*").alias("members")).where("members > 1")
    rows = rows.join(sizes, "key").withColumn("blocks", F.when(F.col("size") > small, F.ceil(2 * F.col("size") / small)).otherwise(1).cast("long"))
    whole = rows.where("blocks = 1").select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "word", "n")
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    long = rows.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    met = long.select("key", part.alias("part"), side.alias("side"), "word", "n")
    dealt = whole.union(met).repartition("key", "part").sortWithinPartitions("key", "part")
    found = dealt.mapInArrow(lambda it: _near(it, small), "word string, near long, n long, form string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.n")).alias("best_n"), F.col("m.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows without cycles: the last word of the chain of forms; each round doubles the steps."""
    at = cut(forms.toDF("word", "root"))
    while True:
        further = at.toDF("root", "next")
        new = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(at)
        moved = new.where("moved").limit(1).count()
        at = new.drop("moved")
        if not moved:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, times: int = TIMES, every: int = EVERY, small: int = SMALL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs``."""
    words = cut(word_counts(docs, id_col, text_col, least, every).where(F.col("n") >= occurrences))
    found = words.join(near_words(words, least, small), "word", "left")
    frequent = F.col("best_n") >= times * F.col("n")
    formed = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")))
    drop(words)
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
