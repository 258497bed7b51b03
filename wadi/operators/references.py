"""Queries that name one place of a corpus: numbers, book and number, or a unit's name; and reading that place.

Rules in their order, the first that holds counts:

1. unit and item as numbers ("2:255", "surah 2 verse 255", "Q2:255");
2. a book's name and a number, in either order;
3. a word for unit and a number;
4. a name, by the names' order: name and number, name and "verse" and number, "verse" and
   number and name; and the whole query being the name, with or without a word for unit.
   A name alone does not count in a query that asks about a topic, or tells of a story
   that bears the name, and for names that are words as well only with a word for unit.

Names are found by joining the word sequences of a query to the table of names, so the
work does not grow with names x queries. The table of names holds their spellings too
(``variants``). Null and blank queries name nothing; repeated queries get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators import understanding as U
from wadi.operators import variants as V

# Patterns of numbers, words for a unit and for an item, and what may stand between.
NUMBERS = (r"^\s*(\d{1,3})\s*[:/\s]\s*(\d{1,3})\s*$", r"sura[h]?\s+(\d{1,3})\s+(?:ayah|ayat|verse|aya)\s+(\d{1,3})", r"(?U)\bq\s*(\d{1,3})\s*:\s*(\d{1,3})\b")
UNIT = "(?:surah?|surat|sourah?|soorah?|sorah?|chapter|سورة|سوره)"
ITEM, ITEM_FIRST, BEFORE_UNIT = "(?:verse|ayah|ayat|aya)", "(?:verse|ayah|ayat|aya|ايه|الايه|ايات)", "(?:(?:of|from|in|من|في) +)?"
UNITS = 114
#: Items that a unit's name alone stands for.
WINDOW = 4
#: Words of a name at most, and names up to which their table is broadcast.
LONGEST, BROADCAST_ROWS = 5, 100_000
#: Variants of a name, its letters at least without an article, and letters of a variant at least.
NAME_VARIANTS, NAME_LETTERS, VARIANT_LETTERS = 60, 5, 4


@dataclass(frozen=True)
class Corpus:
    """Books by name with the edition in their keys, and lists of phrases that keep a name from being a reference."""

    books: dict[str, str]
    topics: U.Phrases = ()
    stories: U.Phrases = ()
    prayer_times: U.Phrases = ()


def name_table(names: DataFrame) -> DataFrame:
    """(spelling, unit, place, needs_unit, story) from (unit, place, name, needs_unit, story): names in small letters, Arabic ones normalised, Latin ones with their spellings.

    Only names with an article, or of some letters, get spellings; long vowels are doubled behind an article only.
    """
    named = names.select("unit", "place", F.lower(F.trim("name")).alias("name"), "needs_unit", "story")
    arabic = F.col("name").rlike(f"[{T.ARABIC_BLOCK}]")
    own = named.select(F.when(arabic, T.normalize_arabic(F.col("name"))).otherwise(F.col("name")).alias("spelling"), F.struct("place", "unit", "needs_unit", "story").alias("id"))
    words = F.split("name", r"[\s\-]+")
    latin = named.where(~arabic).withColumn("article", words[0].isin(*V.ARTICLES) & (F.size(words) > 1))
    made = None
    for article in (True, False):
        some = latin.where(F.col("article") == article).where(F.lit(article) | (F.length("name") >= NAME_LETTERS))
        found = some.lateralJoin(V.spelling_variants(NAME_VARIANTS, lengthen=article)(F.col("name").outer()))
        rows = found.select(F.col("variant").alias("spelling"), F.struct("place", "unit", "needs_unit", "story").alias("id"))
        made = rows if made is None else made.unionByName(rows)
    made = made.where(F.length(F.regexp_replace("spelling", r"[\s\-']", "")) >= VARIANT_LETTERS)
    return V.first_wins(own, made, "id").select("spelling", "id.*", "made")


def _spans(text: Column) -> Column:
    """All sequences of up to ``LONGEST`` words of a text as they stand in it."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    starts = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"(?U)^\w"), i + 1)), lambda i: i.isNotNull())
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(2 * LONGEST - 1), F.lit(2)), lambda n: F.array_join(F.slice(parts, i, n), "")))))


def _extract(text: Column, pattern: Column, group: int = 1) -> Column:
    """The group of the first match, null without one; the pattern is a column."""
    return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(group)), F.lit(""))


def _reference(kind: str, chunk: Column, unit: Column | None = None, item: Column | None = None, whole: bool = False) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), chunk.alias("chunk_id"), (null if unit is None else unit).try_cast("int").alias("unit"), (null if item is None else item).try_cast("int").alias("item"), F.lit(whole).alias("whole"))


def _of_unit(unit: Column, item: Column, whole: bool = False) -> Column:
    number = lambda c: c.try_cast("int").cast("string")
    return _reference("quran_ref", F.concat(F.lit("Q_"), number(unit), F.lit(":"), number(item)), unit, item, whole)


def by_number(query: Column, corpus: Corpus) -> Column:
    """Rules 1 and 2 for a query in small letters; null where neither holds."""
    found = [F.when(query.rlike(p), _of_unit(F.regexp_extract(query, p, 1), F.regexp_extract(query, p, 2))) for p in NUMBERS]
    names = "|".join(sorted(corpus.books, key=len, reverse=True)).replace(" ", r"\s*")
    both = rf"(?:hadith\s+)?({names})\s+(\d+)|(\d+)\s+({names})"
    part = lambda i: F.nullif(F.regexp_extract(query, both, i), F.lit(""))
    name, number = F.coalesce(part(1), part(4)), F.coalesce(part(2), part(3))
    edition = reduce(lambda c, b: c.when(name == b[0], b[1]), corpus.books.items(), F.when(F.lit(False), F.lit("")))
    return F.coalesce(*found, F.when(edition.isNotNull() & number.isNotNull(), _reference("hadith_ref", F.concat(F.lit("H_"), edition, F.lit("_"), number))))


def by_name(query: Column, name: Column, unit: Column, needs_unit: Column, story: Column, corpus: Corpus) -> Column:
    """Rule 4 for a normalised query that holds the name as words; null where it is no reference."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    p = lambda *parts: F.concat(*[F.lit("(?iU)"), *[F.lit(x) if isinstance(x, str) else x for x in parts]])
    numbered = F.coalesce(
        _extract(query, p(quoted, r"\s+(\d{1,3})")),
        _extract(query, p(quoted, r"(?:\s+\w+){0,3}?\s+" + ITEM + r"\s+(\d{1,3})")),
        _extract(query, p(ITEM_FIRST + r"\s+(\d{1,3})\s+" + BEFORE_UNIT.replace(" +", r"\s+") + r"(?:(?:the\s+)?" + UNIT + r"\s+)?", quoted, r"(?!\w)")),
    )
    topic = U.hits(query, corpus.topics) > 0
    told = story & (U.hits(query, corpus.stories) > 0)
    bare = needs_unit & ~query.rlike(r"(?iU)(?<!\w)" + UNIT + r"(?!\w)")
    alone = F.rlike(query, p("^(?:" + UNIT + r"\s+)?", quoted, r"(?:\s+" + UNIT + r")?\s*$")) & ~query.rlike(r"\d")
    return F.when(numbered.isNotNull(), _of_unit(unit, numbered)).when(~topic & ~told & ~bare & alone, _of_unit(unit, F.lit(1), True))


def references(queries: DataFrame, names: DataFrame, corpus: Corpus, id_col: str = "id", query_col: str = "query") -> DataFrame:
    """(id, kind, chunk_id, unit, item, whole, items) of every query (id, query) that names a place; ``names`` as ``name_table`` makes it."""
    q = queries.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), F.lower(F.trim(F.coalesce(query_col, F.lit("")))).alias("small"))
    q = q.withColumn("normal", T.normalize_arabic(F.col("small"))).withColumn("first", by_number(F.col("small"), corpus))
    word = F.regexp_extract("normal", rf"(?i)^{UNIT}\s*(\d{{1,3}})$", 1).try_cast("int")
    timed = (U.hits(F.col("small"), corpus.prayer_times) > 0) if corpus.prayer_times else F.lit(False)
    q = q.withColumn("first", F.coalesce("first", F.when(~timed & word.between(1, UNITS), _of_unit(word, F.lit(1), True)))).withColumn("timed", timed)
    spans = q.where("first IS NULL AND NOT timed AND normal <> ''").select("id", "_row", "normal", F.explode(_spans(F.col("normal"))).alias("spelling"))
    small = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = spans.join(F.broadcast(names) if small else names, "spelling")
    tried = met.select("id", "_row", F.struct("place", "unit", "made", "spelling").alias("order"), by_name(F.col("normal"), F.col("spelling"), F.col("unit"), F.col("needs_unit"), F.col("story"), corpus).alias("ref")).where("ref IS NOT NULL")
    named = tried.groupBy("id", "_row").agg(F.min_by("ref", "order").alias("ref"))
    found = q.where("first IS NOT NULL").select("id", "_row", F.col("first").alias("ref")).unionByName(named)
    return found.select("id", "ref.*", F.when(F.col("ref.whole"), WINDOW).otherwise(1).alias("items"))


def query_words(query: Column, prefixes: U.Phrases) -> Column:
    """Distinct normalised words, each also without a leading article or particle that leaves two letters."""
    words = F.regexp_extract_all(F.lower(T.normalize_arabic(F.coalesce(query, F.lit("")))), F.lit(r"(?U)(\w+)"), F.lit(1))
    bare = lambda w: F.filter(F.array(*[F.when(w.startswith(p) & (F.length(w) - len(p) >= 2), F.substr(w, F.lit(len(p) + 1))) for p in prefixes]), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), bare(w))))) if prefixes else F.array_distinct(words)


def concept_of(query: Column, phrases: U.Phrases, words: U.Phrases, least: int = 3) -> Column:
    """What a definition is asked of: without marks, the phrases in their order, the words, and words of fewer letters."""
    normal = T.normalize_arabic(F.lower(F.coalesce(query, F.lit(""))))
    bare = F.regexp_replace(normal, r"[?؟!،,.:;\x{060c}-\x{060f}\x{061b}\x{061e}\x{061f}]+", " ")
    bare = reduce(lambda c, p: F.replace(c, T.normalize_arabic(F.lit(p)), F.lit(" ")), phrases, bare)
    listed = F.array(*[T.normalize_arabic(F.lit(w)) for w in words]) if words else F.array().cast("array<string>")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: (F.length(w) >= least) & ~F.array_contains(listed, w)), " ")


def route(queries: DataFrame, refs: DataFrame, aliases: DataFrame, s: U.Signals, connectors: U.Phrases = ()) -> DataFrame:
    """What is done with each query (id, query, scope), in fixed steps: a row with language, query, type, scope and, where the search ends early, its result.

    Connecting words go and the language is told anew; the scope is the given one, both where the query
    names both sources, else by signs; a reference (``references``), then a named concept (``aliases``: alias,
    chunk_id; exact after normalising) ends the search if the scope allows; then the type, which widens a legal
    query's scope, turns a short query that is a fragment thematic, and gives short queries and known fragments
    a scope if they have none. A given scope always stands.
    """
    q = queries.select("id", F.coalesce("query", F.lit("")).alias("raw"), F.col("scope").alias("given"))
    q = q.withColumn("query", U.strip_connectors(F.col("raw"), connectors) if connectors else F.col("raw"))
    q = q.withColumn("language", T.language_class(F.col("query"))).withColumn("auto", F.when(U.is_dual(F.col("query"), s), "all").otherwise(U.query_scope(F.col("query"), F.col("language"), s)))
    # all that reads the text comes before the joins, so that none of it is evaluated twice
    q = q.withColumn("own", U.query_type(F.col("query"), F.col("language"), s, F.col("given").isNotNull()))
    q = q.withColumn("kind", U.keyword_kind(F.col("query"), s)).withColumn("leans", U.keyword_scope(F.col("query"), s)).withColumn("scope", F.coalesce("given", "auto"))
    key = T.normalize_text(F.regexp_replace(F.col("query"), "[\"«»']", ""))
    named = aliases.select(T.normalize_text(F.col("alias")).alias("key"), F.col("chunk_id").alias("alias_chunk")).groupBy("key").agg(F.min("alias_chunk").alias("alias_chunk"))
    q = q.withColumn("key", key).join(refs.select("id", F.col("kind").alias("ref_kind"), F.col("chunk_id").alias("ref_chunk")), "id", "left").join(named, "key", "left")
    blank = F.trim("raw") == ""
    ref_exit = F.col("ref_chunk").isNotNull() & U.early_exit(F.col("ref_kind"), F.col("ref_chunk"), F.col("scope"))
    alias_exit = F.col("alias_chunk").isNotNull() & U.early_exit(F.lit("named_concept"), F.col("alias_chunk"), F.col("scope"))
    q = q.withColumn("exit", F.when(blank, None).when(ref_exit, "direct_reference").when(alias_exit, "named_concept"))
    q = q.withColumn("typed", F.when(blank, "thematic").otherwise(F.coalesce("exit", "own")))
    free = F.col("given").isNull() & F.col("exit").isNull() & ~blank
    q = q.withColumn("scope", F.when(blank, F.coalesce("given", F.lit("all"))).when(free & (F.col("typed") == "fiqh") & (F.col("scope") == "hadith"), "all").otherwise(F.col("scope")))
    fragment = (F.col("typed") == "arabic_keyword") & (F.col("kind") == "quran_fragment")
    q = q.withColumn("typed", F.when(F.col("exit").isNull() & fragment, "thematic").otherwise(F.col("typed")))
    short = free & (F.col("scope") == "all")
    scope = F.when(short & (F.col("typed") == "arabic_keyword"), F.col("leans")).when(short & (F.col("typed") == "named_concept") & F.col("alias_chunk").isNull(), "quran").otherwise(F.col("scope"))
    chunk = F.when(F.col("exit") == "direct_reference", F.col("ref_chunk")).when(F.col("exit") == "named_concept", F.col("alias_chunk"))
    return q.select("id", "language", F.col("query").alias("normalized"), F.col("typed").alias("query_type"), scope.alias("scope"), F.col("exit").isNotNull().alias("early_exit"), chunk.alias("chunk_id"))


def write_by_key(chunks: DataFrame, path: str, key: str = "chunk_id", files: int = 64) -> None:
    """A corpus in files of key ranges, sorted, so that a read of few keys opens few files and row groups."""
    chunks.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)


def read_keys(spark: SparkSession, path: str, keys: list[str], key: str = "chunk_id") -> DataFrame:
    """The chunks with these keys (a batch of requests); the filter is pushed to the scan."""
    return spark.read.parquet(path).where(F.col(key).isin(*keys))


def read_references(spark: SparkSession, path: str, refs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(id, place, chunk): the items that references stand for, in order; those that the corpus lacks are left out."""
    units = F.sequence(F.lit(0), F.col("items") - 1)
    asked = refs.select("id", "kind", "chunk_id", "unit", "item", F.posexplode(units).alias("place", "_more"))
    wanted = asked.select("id", "place", F.when(F.col("kind") == "quran_ref", F.concat(F.lit("Q_"), F.col("unit"), F.lit(":"), F.col("item") + F.col("_more"))).otherwise(F.col("chunk_id")).alias("_key"))
    chunks = spark.read.parquet(path)
    return wanted.join(chunks, wanted["_key"] == chunks[key]).drop("_key")
