"""Names, spellings and references over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators import references as R
from wadi.operators import variants as V
from wadi.plans.tables import table
from wadi.plans.understanding import SIGNALS

CORPUS = R.Corpus({"bukhari": "eng-bukhari", "muslim": "eng-muslim", "abu dawud": "eng-abudawud"}, topics=("verses about",), stories=("story of",))


def spelling_variants(spark, sf):
    """The 150 cheapest spellings of each part's name."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    got = names.lateralJoin(V.spelling_variants()(F.col("name").outer()))
    return got.select("name", F.col("rank").cast("long").alias("rank"), F.col("cost").cast("long").alias("cost"), "variant")


def near_vocabulary(spark, sf):
    """Words of parts' names and types with the words of all documents that are at most one edit away."""
    p = table(spark, sf, "part")
    words = p.select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("word"))
    vocabulary = table(spark, sf, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("entry"))
    return V.near_in(words, vocabulary).select("word", "entry", F.col("edits").cast("long").alias("edits"))


def _names(spark, sf):
    """Parts' names as units; some are words as well, of some there are stories."""
    n = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    unit = (F.ascii("name") * 7 + F.length("name")) % 114 + 1
    return n.select(unit.cast("int").alias("unit"), unit.cast("int").alias("place"), "name", (unit % 3 == 0).alias("needs_unit"), (unit % 4 == 0).alias("story"))


def _queries(spark, sf):
    """Each part asked for in one of nine ways."""
    k, name, size = F.col("p_partkey"), F.lower("p_name"), F.col("p_size").cast("string")
    asked = [
        F.concat(size, F.lit(":"), (k % 300).cast("string")), F.concat(F.lit("Bukhari "), k.cast("string")), name, F.concat(F.lit("Surah "), name), F.concat(name, F.lit(" "), size),
        F.concat(F.lit("verse "), size, F.lit(" of the surah "), name), F.concat(F.lit("story of "), name), F.concat(F.lit("surah "), (k % 200).cast("string")), F.regexp_replace(name, rf"([{V.CONSONANTS}])\1", "$1"),
    ]
    query = F.element_at(F.array(*asked), (k % len(asked) + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("id"), query.alias("query"))


def direct_references(spark, sf):
    got = R.references(_queries(spark, sf), R.name_table(_names(spark, sf)), CORPUS)
    return got.select(F.col("id").alias("p_partkey"), "kind", "chunk_id", "whole", F.col("items").cast("long").alias("items"))


def routed_queries(spark, sf):
    """What is done with each of these queries, a third of them within a scope."""
    q = _queries(spark, sf).withColumn("scope", F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "quran").otherwise("hadith")))
    aliases = table(spark, sf, "part").select(F.concat(F.lit("story of "), F.lower("p_name")).alias("alias"), F.concat(F.lit("H_"), "p_brand").alias("chunk_id")).distinct()
    got = R.route(q, R.references(q, R.name_table(_names(spark, sf)), CORPUS), aliases, SIGNALS)
    return got.select(F.col("id").alias("p_partkey"), "language", "query_type", "scope", "early_exit", "chunk_id")


QUERIES = {f.__name__: f for f in (spelling_variants, near_vocabulary, direct_references, routed_queries)}

_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"
_UNIT = "(ascii(n) * 7 + length(n)) % 114 + 1"
SQL = {
    "near_vocabulary": f"""WITH w AS (SELECT DISTINCT unnest({_TOKENS.format("p_name || ' ' || p_type")}) AS word FROM part), v AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS entry FROM documents)
      SELECT word, entry, CASE WHEN word = entry THEN 0 ELSE 1 END AS edits FROM w JOIN v ON abs(length(word) - length(entry)) <= 1 AND (word = entry
        OR length(word) = length(entry) AND len(list_filter(range(1, length(word) + 1), lambda i: word[i] <> entry[i])) = 1
        OR length(word) > length(entry) AND len(list_filter(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:] = entry)) > 0
        OR length(word) < length(entry) AND len(list_filter(range(1, length(entry) + 1), lambda i: entry[:i - 1] || entry[i + 1:] = word)) > 0)""",
    "direct_references": f"""WITH p AS (SELECT p_partkey, p_size, n, {_UNIT} AS u, p_partkey % 9 AS form FROM (SELECT *, lower(p_name) AS n FROM part)),
      r AS (SELECT p_partkey, CASE form WHEN 0 THEN 'Q_' || p_size || ':' || (p_partkey % 300) WHEN 1 THEN 'H_eng-bukhari_' || p_partkey WHEN 3 THEN 'Q_' || u || ':1' WHEN 4 THEN 'Q_' || u || ':' || p_size WHEN 5 THEN 'Q_' || u || ':' || p_size
          WHEN 7 THEN CASE WHEN p_partkey % 200 BETWEEN 1 AND 114 THEN 'Q_' || (p_partkey % 200) || ':1' END WHEN 6 THEN NULL ELSE CASE WHEN u % 3 <> 0 THEN 'Q_' || u || ':1' END END AS chunk_id, form IN (2, 3, 7, 8) AS whole FROM p)
      SELECT p_partkey, CASE WHEN chunk_id LIKE 'H%' THEN 'hadith_ref' ELSE 'quran_ref' END AS kind, chunk_id, whole, CASE WHEN whole THEN 4 ELSE 1 END AS items FROM r WHERE chunk_id IS NOT NULL""",
}
