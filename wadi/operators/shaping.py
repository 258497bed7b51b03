"""Result rows, texts for indexes, validation, summaries and session tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_request(query: Column, top_k: Column, scope: Column, scopes: tuple[str, ...], longest: int = 500, most: int = 20) -> Column:
    """Null for a valid request, else the first thing that is wrong."""
    n = F.length(F.trim(F.coalesce(query, F.lit(""))))
    return F.when((n < 1) | (F.length(query) > longest), "query").when(~F.coalesce(top_k.between(1, most), F.lit(False)), "top_k").when(~F.coalesce(scope.isin(*scopes), F.lit(False)), "scope")


def result_rows(rows: DataFrame, scores: list[str], digits: int = 6) -> DataFrame:
    """Scores rounded, missing ones 0."""
    return rows.withColumns({s: F.round(F.coalesce(s, F.lit(0.0)), digits) for s in scores})


def display(kind: Column, shapes: dict[str, dict[str, Column]]) -> Column:
    """One structure for all kinds: of each kind the fields that it shows, the others null."""
    names = sorted({n for shape in shapes.values() for n in shape})

    def field(n: str) -> Column:
        out = F.lit(None).cast("string")
        for k, shape in shapes.items():
            if n in shape:
                out = F.when(kind == k, shape[n].cast("string")).otherwise(out)
        return out.alias(n)

    return F.struct(*[field(n) for n in names])


def capped_text(parts: list[tuple[Column, int | None]], separator: str = " ") -> Column:
    """Parts in their order, each to its own length, empty ones left out."""
    shown = [F.nullif(F.trim(F.substring(c, 1, n) if n else c), F.lit("")) for c, n in parts]
    return F.concat_ws(separator, *shown)


def client_filter(shown: str, source: Column, has_commentary: Column) -> Column:
    """What a reader's filter leaves; passages count as verses, commentary needs one."""
    book = source.isin("Quran_Tafsir", "Quran_Passage")
    return {"all": F.lit(True), "ayahs": book, "hadiths": source.isin("Hadith", "Hadith_Cluster"), "tafsir": book & ((source == "Quran_Passage") | has_commentary)}[shown]


def merge_synonyms(rows: DataFrame, canonical: Column, synonyms: Column) -> DataFrame:
    """(term, synonyms): lists of keys with one canonical form merged in key order, without the term itself, repeats and empties."""
    base = rows.select("key", canonical.alias("term"), F.filter(synonyms, lambda x: x != "").alias("s")).where("term <> ''")
    lists = base.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("key", "s"))).alias("all"))
    own = F.filter(F.array_distinct(F.flatten(F.transform("all", lambda x: x["s"]))), lambda x: x != F.col("term"))
    return lists.select("term", own.alias("synonyms")).where(F.size("synonyms") > 0)


def variant_table(pairs: DataFrame, known: DataFrame, english: DataFrame, least_letters: int) -> DataFrame:
    """(variant, replacement, reason) from (variant, replacement): why a variant is dropped; a null reason keeps it."""
    sets = pairs.groupBy("variant").agg(F.collect_set("replacement").alias("r"))
    sets = sets.join(known.select("variant", F.lit(True).alias("known")).distinct(), "variant", "left").join(english.select("variant", F.lit(True).alias("english")).distinct(), "variant", "left")
    letters = F.length(F.regexp_replace("variant", r"[\s\-'’`]", ""))
    reason = F.when(F.col("known"), "known").when(F.size("r") > 1, "ambiguous").when(letters < least_letters, "short").when(F.col("english"), "english")
    return sets.select("variant", F.when(reason.isNull(), F.element_at("r", 1)).alias("replacement"), reason.alias("reason"))


def longest_letter_run(text: Column, least: int) -> Column:
    """Length of the longest run of one letter of at least ``least``; 0 without one."""
    runs = F.regexp_extract_all(text, F.lit(rf"((.)\2{{{least - 1},}})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def trailing_run(values: Column) -> Column:
    """How many equal values end the array."""
    last = F.element_at(values, -1)
    step = lambda s, x: F.when(x.eqNullSafe(last), s + 1).otherwise(0)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0), step)).otherwise(0)


def trailing_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, run): how many rows of equal value end each key, by counts after the last row of another value; no key's rows come together."""
    last = rows.groupBy(by, value).agg(F.max(order).alias("_at")).groupBy(by).agg(F.max_by(value, "_at").alias("_last"), F.array_sort(F.collect_list("_at")).alias("_ats"))  # one for each value
    other = last.select(F.col(by).alias("_by"), F.when(F.size("_ats") > 1, F.element_at("_ats", -2)).alias("_other"))
    held = rows.join(other, F.col(by).eqNullSafe(F.col("_by")))
    return held.where(F.col("_other").isNull() | (F.col(order) > F.col("_other"))).groupBy(by).agg(F.count("*").cast("int").alias("run"))


def summaries(rows: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """(by, summary) of the least values of each key as ``summary`` writes them; only ``most`` rows of a key come together."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(value))
    least = rows.where(F.col(value).isNotNull()).select(by, value).withColumn("_place", place).where(F.col("_place") <= most)
    heads = least.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ", ").alias("_head"))
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count(value).alias("_n"))
    both = counts.join(heads, F.col("_by").eqNullSafe(F.col(by)), "left")
    text = F.coalesce("_head", F.lit(""))
    return both.select(F.col("_by").alias(by), F.when(F.col("_n") > most, F.concat(text, F.lit(" +"), (F.col("_n") - most).cast("string"))).otherwise(text).alias("summary"))


#: A word between white space as the engine's regular expressions know it.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _spans_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [(m.group(), *m.span()) for m in _WORD.finditer(t)])


def word_spans(text: Column) -> Column:
    """array<struct<word, start, end>> of white-space words by characters, in one pass over the text."""
    return F.pandas_udf(_spans_of, "array<struct<word:string,start:int,end:int>>")(text)


def mapped_bounds(spans: DataFrame, chars: DataFrame) -> DataFrame:
    """(group, word, first, last): the places that the first and the last kept character of each span have on the other side.

    ``spans`` are (group, word, start, end), ``chars`` (group, at, to, deleted). Neither side is broadcast: rows that
    were exploded count as their source in the optimizer's sizes.
    """
    met = spans.hint("merge").join(chars.where(~F.col("deleted")), "group").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    found = met.groupBy("group", "word").agg(F.min_by("to", "at").alias("first"), F.max_by("to", "at").alias("last"))
    return spans.select("group", "word").hint("merge").join(found, ["group", "word"], "left")


def spans_of_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group, word, chunks) in order; an empty list where the chunks' sizes do not add up to the span's. Neither side is broadcast."""
    met = spans.hint("merge").join(chunks, "group").where((F.col("c_start") >= F.col("start")) & (F.col("c_start") < F.col("end")))
    got = met.groupBy("group", "word", "start", "end").agg(F.array_sort(F.collect_list(F.struct("c_start", "chunk"))).alias("c"), F.sum("size").alias("size"))
    fits = got.select("group", "word", F.when(F.col("size") == F.col("end") - F.col("start"), F.transform("c", lambda x: x["chunk"])).alias("chunks"))
    return spans.select("group", "word").hint("merge").join(fits, ["group", "word"], "left").select("group", "word", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


def batches(rows: DataFrame, by: str, length: str, budget: int, most: int = 8) -> DataFrame:
    """(by, id, batch): ``rows`` with a batch number by length within ``by``, at most ``most`` rows and ``budget`` padded tokens in a batch.

    A batch is closed when its longest, which is the row at hand, times its rows would pass the budget. The
    rows of a lot are streamed in order; a task keeps two numbers of it. A null length is 0.
    """
    kind = rows.schema[by].dataType.simpleString()
    dealt = rows.select(F.col(by), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_n"), F.col("id").cast("long").alias("id")).repartition(by).sortWithinPartitions(by, "_n", "id")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, number, count = (), 0, 0
        for part in parts:
            out = []
            for own, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if (own,) != lot:
                    lot, number, count = (own,), 0, 0
                if count >= most or count and n * (count + 1) > budget:
                    number, count = number + 1, 0
                count += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.int32())], names=[by, "id", "batch"])

    return dealt.mapInArrow(run, f"`{by}` {kind}, id long, batch int")


def summary(values: Column, most: int, separator: str = ", ", more: str = " +") -> Column:
    """The first values, and how many more there are."""
    head = F.array_join(F.slice(values, 1, most), separator)
    return F.when(F.size(values) > most, F.concat(head, F.lit(more), (F.size(values) - most).cast("string"))).otherwise(head)


def overlay(committed: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Committed rows, and of the live ones those whose key is not among them."""
    return committed.withColumn("live", F.lit(False)).unionByName(live.join(committed.select(*keys), keys, "left_anti").withColumn("live", F.lit(True)))


def top_up(rows: DataFrame, pool: DataFrame, k: int, floor: float) -> DataFrame:
    """Rows (query_id, doc_id, score) of each query filled to ``k`` from the pool (query_id, doc_id, rank), at the floor score."""
    new = pool.join(rows.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = rows.select("query_id", "doc_id", "score", F.lit(0).alias("late"), F.lit(0).cast("long").alias("rank")).unionByName(new.select("query_id", "doc_id", F.lit(floor).alias("score"), F.lit(1).alias("late"), F.col("rank").cast("long").alias("rank")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("late", F.when(F.col("late") == 0, -F.col("score")), "rank", "doc_id"))
    return both.withColumn("place", place).where((F.col("late") == 0) | (F.col("place") <= k)).select("query_id", "doc_id", "score", "place")


def clusters(text: Column) -> Column:
    """User-perceived characters (extended grapheme clusters)."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def fractions_to_clusters(start: Column, end: Column, n: Column) -> Column:
    """(from, to) clusters that a span given in shares of a word covers; one at least."""
    first = F.least(F.floor(start * n), n - 1)
    return F.struct(first.alias("from"), F.least(F.greatest(F.ceil(end * n), first + 1), n).alias("to"))
