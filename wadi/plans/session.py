"""Session pieces, corpus checks and audio features over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators import audio
from wadi.operators import narrations as N
from wadi.operators import session as S
from wadi.plans.tables import table

#: Stand-ins for the word lists of narrations.
CHAINS = N.Chains(transmission=("the", "of", "and"), speech=("is", "was", "to"), prophet=("that", "with"))
CORE, RESIDUALS = "bcdfghjklmnpqrstvwxyz", "aeiou"


def phoneme_chunks(spark, sf):
    """Chunks of consonant runs with at most one vowel."""
    chunks = S.phoneme_chunks(F.lower("text"), CORE, RESIDUALS)
    d = table(spark, sf, "documents").select("doc_id", chunks.alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


def refunded_seconds(spark, sf):
    """Three frames a word; the first hundred characters of each turn, from frame 5 on."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    c = c.withColumn("frames", F.transform("w", lambda _, i: i * 3))
    return c.select("conv_id", "turn", F.round(S.refunded_seconds(F.transform("w", F.length), F.col("frames"), F.lit(100), F.lit(5)), 6).alias("seconds"))


def stage_budgets(spark, sf):
    """Budgets of queries whose kinds go round with the order key."""
    kinds = F.array(*[F.lit(k) for k in [*S.FUSION_BY_KIND, "other"]])
    o = table(spark, sf, "orders").select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % 10).cast("int")).alias("kind"))
    return o.select("o_orderkey", "kind", S.stage_budgets(F.col("kind")).alias("b")).select("o_orderkey", "kind", "b.dense", "b.lexical", "b.fusion", "b.rerank")


def ngram_counts(spark, sf):
    return S.vocabulary(table(spark, sf, "documents"), "text")


def missing_targets(spark, sf):
    """Events of users that are no customers, by type; every tenth key is a comment."""
    e = table(spark, sf, "events")
    alias = F.concat(F.when(F.col("event_id") % 10 == 0, "_").otherwise("e"), F.col("event_id").cast("string"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 3 <> 0")
    gone = S.missing_targets(e.select("event_type", "user_id", alias.alias("alias")), known, "alias", "user_id")
    return gone.groupBy("event_type").agg(F.count("*").alias("n"), F.min("alias").alias("first"), F.max("alias").alias("last"))


def since_last(spark, sf):
    """Events of each user after the last one of value over 30."""
    return S.since_last(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 30).select("user_id", "event_id")


def hit_rates(spark, sf):
    got = S.hit_rates(table(spark, sf, "events"), "event_type", F.col("user_id"))
    return got.select("event_type", "requests", "hits", F.round("rate", 6).alias("rate"))


def mel_features(spark, sf):
    """Features of each vector as a waveform of 64 samples, in short frames."""
    s = audio.MelSettings(frame=32, hop=8, fft=32, mels=6)
    rows = table(spark, sf, "embeddings").select("vec_id", audio.mel_features(F.col("embedding"), s).alias("m"))
    return rows.select("vec_id", F.posexplode("m").alias("at", "row")).select("vec_id", "at", F.transform("row", lambda x: F.round(x.cast("double"), 4)).alias("features"))


def own_words_start(spark, sf):
    """Where the text after an opening chain starts, for documents that open with one."""
    words = F.split(F.btrim(F.regexp_replace("text", r"\s+", " ")), " ")
    # only texts that open with one have their other words looked at
    opened = table(spark, sf, "documents").where(N.opens(words, CHAINS))
    kinds = opened.select("doc_id", N.word_kinds(words, CHAINS).alias("kinds"))
    return kinds.select("doc_id", N.own_words_start(F.col("kinds"), CHAINS.gap).cast("long").alias("start"))


QUERIES = {f.__name__: f for f in (phoneme_chunks, refunded_seconds, stage_budgets, ngram_counts, missing_targets, since_last, hit_rates, mel_features, own_words_start)}

_TOK = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"
_KINDS = ", ".join(f"({i}, '{k}', {n})" for i, (k, n) in enumerate([*S.FUSION_BY_KIND.items(), ("other", S.FUSION)]))
_GRAM = "SELECT {k} AS size, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS gram FROM d"
SQL = {
    "phoneme_chunks": f"""WITH c AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:{"|".join(c + "+" for c in CORE)})[{RESIDUALS}]?') AS c FROM documents)
      SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS chunks_md5 FROM c""",
    "refunded_seconds": f"""WITH t AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
      s AS (SELECT *, sum(length(x)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS z FROM u), e AS (SELECT conv_id, turn, coalesce(min(i) FILTER (WHERE z >= 100), max(i)) AS i FROM s GROUP BY conv_id, turn)
      SELECT t.conv_id, t.turn, round(coalesce(greatest(0, e.i * 3 - 5) * 0.04, 0), 6)::DOUBLE AS seconds FROM t LEFT JOIN e USING (conv_id, turn)""",
    "stage_budgets": f"""WITH k(i, kind, fusion) AS (VALUES {_KINDS})
      SELECT o_orderkey, kind, CASE WHEN kind = 'arabic_keyword' THEN 100 ELSE 200 END AS dense, 200 AS lexical, fusion, least(fusion, 120) AS rerank FROM orders JOIN k ON i = o_orderkey % 10""",
    "ngram_counts": f"""WITH d AS (SELECT regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*') AS w FROM (SELECT DISTINCT text FROM documents WHERE text <> '')),
      g AS (SELECT 1 AS size, unnest(list_filter(w, lambda x: x = lower(x))) AS gram FROM d UNION ALL {_GRAM.format(k=2)} UNION ALL {_GRAM.format(k=3)}) SELECT size, gram, count(*) AS n FROM g GROUP BY size, gram""",
    "missing_targets": """WITH e AS (SELECT event_type, user_id, CASE WHEN event_id % 10 = 0 THEN '_' ELSE 'e' END || event_id AS alias FROM events)
      SELECT event_type, count(*) AS n, min(alias) AS first, max(alias) AS last FROM e WHERE alias NOT LIKE '\\_%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 3 <> 0) GROUP BY event_type""",
    "since_last": """WITH l AS (SELECT user_id, max(event_id) FILTER (WHERE value > 30) AS last FROM events GROUP BY user_id)
      SELECT user_id, event_id FROM events JOIN l USING (user_id) WHERE last IS NULL OR event_id > last""",
    "own_words_start": f"""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
      w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, trim(unnest(ws), '{N.TRIMMED.replace("'", "''")}') AS w FROM d),
      k AS (SELECT doc_id, i, CASE WHEN w IN {CHAINS.prophet} THEN 'p' WHEN w IN {CHAINS.transmission} THEN 't' WHEN w IN {CHAINS.speech} THEN 's' ELSE 'o' END AS k FROM w),
      x AS (SELECT *, coalesce(max(CASE WHEN k = 't' THEN i END) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p, lead(k) OVER b AS after, lag(k) OVER b AS before FROM k WINDOW b AS (PARTITION BY doc_id ORDER BY i)),
      e AS (SELECT *, CASE WHEN k = 'p' THEN CASE WHEN before IN ('t', 's') THEN i - 1 WHEN p + 1 < i THEN p + 1 ELSE i END WHEN k = 's' AND p >= 0 AND after IS DISTINCT FROM 't' THEN i WHEN p >= 0 AND i - p > 12 THEN p + 1 END AS s FROM x)
      SELECT doc_id, coalesce(arg_min(s, i) FILTER (WHERE s IS NOT NULL), max(i) FILTER (WHERE k = 't') + 1) AS start FROM e GROUP BY doc_id HAVING bool_or(i < 3 AND k = 't')""",
    "hit_rates": "SELECT event_type, count(*) AS requests, count(*) - count(DISTINCT user_id) AS hits, round((count(*) - count(DISTINCT user_id)) / count(*), 6) AS rate FROM events GROUP BY event_type",
}
