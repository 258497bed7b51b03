"""Query understanding and score adjustment over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators import adjust as A
from wadi.operators import understanding as U
from wadi.plans.tables import table

#: Phrases of the driver's invented prose stand for the lists of a real corpus.
SIGNALS = U.Signals(
    fragments=("thwhesou",), comparative_strong=("hehely",), comparative_weak=("inoran", "ononst"), dual_source=("thatin the",), definitional_first=("rewh",), definitional_second=("orre",),
    definitional_strong=("orantion", "thth"), legal=("inesea", "onble"), narrative=("thon", "leau"), historical=("ndst", "aux"), story_frames=("edst", "ment"), prayer_times=("onrein", "tion"),
    questions=("qui",), theme_nouns=("la",), connectors=("des",), connector_prefix="e", ambiguous=("le le",), book=("the the", "of the", "la"), reports=("to the", "in the", "le"), emotions=("worthless", "was"),
    book_terms=("the", "of the", "la"), report_terms=("to", "und"), legal_terms=("is that", "le"),
)


def _texts(spark, sf):
    language = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "arabic").otherwise("mixed")
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), language.alias("language"))


def query_types(spark, sf):
    return _texts(spark, sf).select("doc_id", U.query_type(F.col("text"), F.col("language"), SIGNALS, F.col("doc_id") % 5 == 0).alias("query_type"))


def query_scopes(spark, sf):
    return _texts(spark, sf).select("doc_id", U.query_scope(F.col("text"), F.col("language"), SIGNALS).alias("scope"))


def keyword_scopes(spark, sf):
    """Each of a text's lines as a query of its own."""
    lines = _texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "q"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), U.keyword_scope(F.col("q"), SIGNALS).alias("scope"), U.keyword_kind(F.col("q"), SIGNALS).alias("kind"))


def early_exits(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "quran_ref").when(F.col("o_orderkey") % 4 == 1, "hadith_ref").when(F.col("o_orderkey") % 4 == 2, "named_concept").otherwise("other")
    chunk = F.concat(F.when(F.col("o_custkey") % 3 == 0, "Q_").when(F.col("o_custkey") % 3 == 1, "H_").otherwise("X_"), F.col("o_custkey").cast("string"))
    scope = F.when(F.col("o_orderstatus") == "O", "quran").when(F.col("o_orderstatus") == "F", "hadith").otherwise("all")
    return o.select("o_orderkey", U.direct_source(kind, chunk).alias("source"), U.early_exit(kind, chunk, scope).alias("exits"))


def instructions(spark, sf):
    o = table(spark, sf, "orders")
    types = ["fiqh", "definitional", "narrative", "comparative", "thematic"]
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    scope = F.when(F.col("o_orderstatus") == "O", "quran").when(F.col("o_orderstatus") == "F", "hadith").otherwise("all")
    language = F.when(F.col("o_custkey") % 2 == 0, "mixed").otherwise("english")
    return o.groupBy(U.instruction(kind, scope, language).alias("instruction")).agg(F.count("*").alias("n"))


def rerank_queries(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", U.rerank_query(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.col("source"))).alias("query"))


def stripped_frames(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(U.strip_frame(F.col("text"), ("of the", "is that", "|"))).alias("digest"))


def cache_keys(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", U.cache_key(F.col("o_orderpriority"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))).alias("key"))


def book_priorities(spark, sf):
    ranks = {"furniture": 0, "building": 1, "machinery": 2}
    c = table(spark, sf, "customer").withColumn("chunk", F.concat(F.lit("H_eng-"), F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")))
    return c.groupBy(U.book_priority(F.col("chunk"), ranks).alias("priority")).agg(F.count("*").alias("n"))


def candidates(spark, sf):
    """Order lines as fused candidates: the order is the query, its type and the features come from the keys."""
    c, types = F.col, ["fiqh", "definitional", "narrative", "thematic", "arabic_keyword"]
    sources = ["Quran_Tafsir", "Quran_Passage", "Hadith", "Hadith_Cluster"]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("query_id"), c("l_partkey").alias("doc_id"), c("l_linenumber").alias("place"), pick(types, c("l_orderkey") % 5).alias("query_type"), pick(sources, c("l_suppkey") % 4).alias("source_type"),
        (c("l_extendedprice") / 1e6).alias("score"), F.when(c("l_returnflag") != "R", c("l_linenumber") * 8).alias("dense_rank"), F.when(c("l_linestatus") != "O", c("l_linenumber")).alias("bm25_rank"),
        (c("l_quantity").cast("int") % 20).alias("window_size"), F.when(c("l_partkey") % 3 != 0, (c("l_partkey") % 20).cast("int")).alias("anchor_pos"), (c("l_partkey") % 7 == 0).alias("short_reference"),
        ((c("l_orderkey") % 5).isin(2, 3) & (c("l_orderkey") % 3 == 0)).alias("event_intent"), (c("l_partkey") % 5 == 0).alias("off_topic_event"),
        (c("l_orderkey") % 3).alias("checked"), (c("l_partkey") % 2).alias("matched"), (c("l_orderkey") % 2).alias("entities"), (c("l_partkey") % 2).alias("entities_matched"),
    )


def score_adjustments(spark, sf):
    return A.adjusted(candidates(spark, sf)).select("query_id", "doc_id", "place", F.round("score", 9).alias("score"), "mismatch")


def lexical_floors(spark, sf):
    return A.lexical_floor(candidates(spark, sf), F.lit(0.65)).select("query_id", "doc_id", "place", F.round("score", 9).alias("score"))


def reference_only(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "Hadith").otherwise("Quran_Tafsir").alias("source_type"), F.col("text").alias("translation"))
    return A.without_references(rows, r"[Tt]he|[Oo]f").select("doc_id")


def both_sides_boost(spark, sf):
    d = _texts(spark, sf)
    a, b = F.array(F.lit("thon"), F.lit("of")), F.array(F.lit("worthless"), F.lit("tion"))
    return d.select("doc_id", F.round(A.both_sides(F.lit(0.5), F.lower("text"), a, b), 6).alias("score"))


def side_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(A.side_score(F.col("l_discount") * 5, [F.col("l_tax") * 10, F.col("l_quantity") / 50]), 6).alias("score"))


def best_scores(spark, sf):
    return candidates(spark, sf).select("query_id", "doc_id", "place", A.best_score(F.when(F.col("dense_rank") > 16, F.round("score", 8)), F.when(F.col("bm25_rank") > 2, 0.25)).alias("score"))


def mismatch_guard(spark, sf):
    rows = A.adjusted(candidates(spark, sf))
    return A.keep_if_enough(rows, "mismatch").groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("mismatch").cast("int")).alias("flagged"))


def representatives(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal", (F.col("c_custkey") % 97).alias("other"), (F.col("c_custkey") * 7 % 1009 * 100000 + F.col("c_custkey")).alias("priority"))
    return A.representative(c.drop("c_mktsegment"), "c_nationkey", "priority", ["c_acctbal", "other"])


def stem_caps(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("place"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("stem"), (F.col("value") > 3).alias("single"), (F.col("event_id") % 17 == 0).alias("anchored"))
    return A.stem_caps(e, F.lit(3), F.lit(12)).select("query_id", "place")


def section_heads(spark, sf):
    """The first six turns of a conversation up to a gap; every eleventh row is missing."""
    rows = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("number")).where((F.col("conv_id") + F.col("number")) % 11 != 0)
    return A.leading_run(rows, "conv_id", "number", 6).select("conv_id", "number")


def injected_hints(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    hints = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("doc_id"))
    return A.inject(rows, hints)


def first_attempts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", (F.floor(F.col("value")) % 5 + F.col("user_id") % 3).alias("attempt"))
    return A.first_attempt(e).groupBy("query_id", "attempt").agg(F.count("*").alias("n"))


_CAND = """WITH c AS (
  SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_linenumber AS place, ['fiqh', 'definitional', 'narrative', 'thematic', 'arabic_keyword'][l_orderkey % 5 + 1] AS qt,
    ['Quran_Tafsir', 'Quran_Passage', 'Hadith', 'Hadith_Cluster'][l_suppkey % 4 + 1] AS st, l_extendedprice / 1e6 AS score, CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 8 END AS dr,
    CASE WHEN l_linestatus <> 'O' THEN l_linenumber END AS br, CAST(floor(l_quantity) AS INT) % 20 AS w, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 20 END AS ap, l_partkey % 7 = 0 AS sr,
    l_orderkey % 5 IN (2, 3) AND l_orderkey % 3 = 0 AS ev, l_partkey % 5 = 0 AS oe, l_orderkey % 3 AS ck, l_partkey % 2 AS mt, l_orderkey % 2 AS en FROM lineitem
), f AS (
  SELECT *, (ev AND st = 'Hadith' AND oe) OR (qt = 'narrative' AND ((st LIKE 'Quran%' AND ck >= 1 AND mt = 0) OR (st = 'Hadith' AND en >= 1 AND mt = 0))) AS mismatch,
    score * CASE WHEN st = 'Hadith_Cluster' THEN (CASE WHEN qt = 'fiqh' THEN 0.2 ELSE 0.3 END) ELSE 1 END
    * CASE WHEN st LIKE 'Hadith%' AND sr THEN 0.15 ELSE 1 END
    * CASE WHEN ev AND st = 'Hadith' THEN (CASE WHEN oe THEN 0.35 ELSE 1.4 END) WHEN ev AND st = 'Quran_Passage' AND w >= 13 THEN 0.65 ELSE 1 END
    * CASE WHEN st = 'Quran_Tafsir' AND qt <> 'arabic_keyword' THEN 0.85 ELSE 1 END
    * CASE WHEN st = 'Quran_Passage' AND qt = 'definitional' AND w > 6 THEN greatest(0.5, 0.95 - (w - 6) * 0.05) WHEN st = 'Quran_Passage' AND qt NOT IN ('narrative', 'definitional') AND w >= 13 THEN 0.8 ELSE 1 END
    * CASE WHEN st = 'Quran_Passage' AND qt IN ('fiqh', 'definitional') AND w >= 4 AND ap >= floor(w * 2 / 3) THEN greatest(0.55, 0.85 - ap / w * 0.35) ELSE 1 END
    * CASE WHEN qt = 'narrative' AND st LIKE 'Quran%' AND ck >= 1 AND mt = 0 THEN 0.3 WHEN qt = 'narrative' AND st = 'Hadith' AND en >= 1 AND mt = 0 THEN 0.35 ELSE 1 END
    * CASE WHEN br = 1 AND ((qt = 'fiqh' AND dr <= 30) OR qt = 'definitional' OR (qt = 'arabic_keyword' AND (dr IS NULL OR dr <= 30))) THEN 3 ELSE 1 END AS s FROM c
), a AS (SELECT *, CASE WHEN dr IS NULL AND br IS NOT NULL AND (qt = 'fiqh' OR (qt = 'definitional' AND br > 5)) THEN least(s, 0.008) ELSE s END AS adjusted FROM f)
"""


def _hits(phrases):
    return "(" + " + ".join(f"CAST(contains(t, '{p}') AS INT)" for p in phrases) + ")"


_S = SIGNALS
_TEXTS = """WITH d AS (SELECT doc_id, trim(replace(lower(coalesce(text, '')), chr(65279), '')) AS t, lower(coalesce(text, '')) AS raw,
  CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'arabic' ELSE 'mixed' END AS language FROM documents)"""
_DEF = f"({_hits(_S.definitional_first)} > 0 OR (language <> 'arabic' AND {_hits(_S.definitional_second)} > 0)) AND {_hits(_S.definitional_strong)} > 0"
_LINKED = f"len(list_filter(string_split_regex(t, '\\s+'), lambda x: x IN ('{_S.connectors[0]}') OR (starts_with(x, '{_S.connector_prefix}') AND length(x) > 1))) > 0"
_HAS = lambda p: f"list_contains(string_split_regex(t, '\\s+'), '{p}')"
_SCOPE = lambda b, r: f"CASE WHEN {b} > {r} THEN 'quran' WHEN {r} > {b} THEN 'hadith' ELSE 'all' END"
_WORD = lambda p: f"CAST({f'''contains(t, '{p}')''' if ' ' in p else _HAS(p)} AS INT)"
_FELT = f"CASE WHEN language <> 'arabic' AND {_hits(_S.book)} = 0 AND len(list_intersect(regexp_extract_all(raw, '[\\pL\\pN_]+'), ['worthless', 'was'])) > 0 THEN 1 ELSE 0 END"

QUERIES = {
    f.__name__: f
    for f in (query_types, query_scopes, keyword_scopes, early_exits, instructions, rerank_queries, stripped_frames, cache_keys, book_priorities, score_adjustments, lexical_floors, reference_only, both_sides_boost, side_scores, best_scores, mismatch_guard, representatives, stem_caps, section_heads, injected_hints, first_attempts)
}
SQL = {
    "query_types": f"""{_TEXTS} SELECT doc_id, CASE WHEN {_hits(_S.fragments)} > 0 THEN 'named_concept'
  WHEN {_hits(_S.comparative_strong)} >= 1 OR {_hits(_S.comparative_weak)} >= 2 THEN 'comparative' WHEN {_hits(_S.dual_source)} > 0 THEN 'thematic'
  WHEN {_DEF} AND {_hits(_S.legal)} > 0 THEN 'fiqh' WHEN {_DEF} THEN 'definitional' WHEN {_hits(_S.legal)} > 0 THEN 'fiqh'
  WHEN {_hits(_S.narrative)} > 0 AND {_hits(_S.historical)} > 0 AND {_hits(_S.story_frames)} = 0 AND doc_id % 5 <> 0 THEN 'thematic' WHEN {_hits(_S.narrative)} > 0 THEN 'narrative' WHEN {_hits(_S.prayer_times)} > 0 THEN 'thematic'
  WHEN language = 'arabic' AND len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) <= 3 AND (t = 'le le' OR NOT ({_HAS('qui')} OR {_HAS('la')} OR {_LINKED})) THEN 'arabic_keyword' ELSE 'thematic' END AS query_type FROM d""",
    "query_scopes": f"{_TEXTS}, n AS (SELECT doc_id, {_hits(_S.book)} + {_FELT} AS b, {_hits(_S.reports)} AS r FROM d) SELECT doc_id, {_SCOPE('b', 'r')} AS scope FROM n",
    "keyword_scopes": f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS q, generate_subscripts(l, 1) - 1 AS line FROM s),
d AS (SELECT doc_id, line, trim(replace(lower(trim(q)), chr(65279), '')) AS t FROM x), n AS (SELECT *, {' + '.join(map(_WORD, _S.book_terms))} AS b, {' + '.join(map(_WORD, _S.report_terms + _S.legal_terms))} AS r FROM d)
SELECT doc_id, line, {_SCOPE('b', 'r')} AS scope, CASE WHEN contains(t, 'thwhesou') THEN 'quran_fragment' WHEN contains(t, 'le le') OR contains('le le', t) THEN 'ambiguous_term' ELSE 'normal' END AS kind FROM n""",
    "early_exits": """WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'quran' WHEN 1 THEN 'hadith' WHEN 2 THEN (CASE o_custkey % 3 WHEN 0 THEN 'quran' WHEN 1 THEN 'hadith' ELSE 'unknown' END) ELSE 'unknown' END AS source,
  CASE o_orderstatus WHEN 'O' THEN 'quran' WHEN 'F' THEN 'hadith' ELSE 'all' END AS scope FROM orders) SELECT o_orderkey, source, scope = 'all' OR scope = source AS exits FROM k""",
    "instructions": """WITH k AS (SELECT ['fiqh', 'definitional', 'narrative', 'comparative', 'thematic'][o_orderkey % 5 + 1] AS qt, CASE o_orderstatus WHEN 'O' THEN 'quran' WHEN 'F' THEN 'hadith' END AS scope, o_custkey % 2 = 0 AS mixed FROM orders)
SELECT CASE WHEN qt = 'narrative' THEN qt WHEN qt <> 'thematic' THEN coalesce(scope, qt) WHEN mixed THEN 'mixed' ELSE coalesce(scope, 'general') END AS instruction, count(*) AS n FROM k GROUP BY 1""",
    "rerank_queries": """WITH d AS (SELECT doc_id, source, trim(text) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN length(t) > 300 THEN regexp_replace(substring(t, 1, 300), '^(.*) .*$', '\\1', 's') ELSE t END AS q FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND coalesce(source, '') <> '' THEN q || ': ' || source ELSE q END AS query FROM c""",
    "stripped_frames": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT *, trim(regexp_replace(replace(replace(replace(t, 'of the', ' '), 'is that', ' '), '|', ' '), '[ \\t\\n\\r]+', ' ', 'g')) AS bare FROM d)
SELECT doc_id, md5(CASE WHEN length(bare) >= 2 THEN bare ELSE t END) AS digest FROM b""",
    "cache_keys": "SELECT o_orderkey, md5(lower(o_orderpriority) || '|' || o_orderkey || ',' || o_custkey) AS key FROM orders",
    "book_priorities": "SELECT CASE lower(c_mktsegment) WHEN 'furniture' THEN 0 WHEN 'building' THEN 1 WHEN 'machinery' THEN 2 ELSE 9 END AS priority, count(*) AS n FROM customer GROUP BY 1",
    "score_adjustments": _CAND + "SELECT query_id, doc_id, place, round(adjusted, 9) AS score, coalesce(mismatch, false) AS mismatch FROM a",
    "lexical_floors": _CAND + """SELECT query_id, doc_id, place, round(CASE WHEN qt <> 'fiqh' AND dr IS NULL AND br <= (CASE WHEN qt = 'definitional' THEN 20 ELSE 10 END)
  THEN greatest(score, 0.65 / 90 * CASE WHEN qt = 'definitional' THEN 0.8 ELSE 0.6 - (br - 1) * 0.05 END) ELSE score END, 9) AS score FROM a""",
    "reference_only": "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND length(trim(coalesce(text, ''))) BETWEEN 1 AND 79 AND regexp_matches(trim(coalesce(text, '')), '[Tt]he|[Oo]f'))",
    "both_sides_boost": "SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'thon') AND (contains(lower(coalesce(text, '')), 'worthless') OR contains(lower(coalesce(text, '')), 'tion')) THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS score FROM documents",
    "side_scores": "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(l_discount * 5, 0.5 * greatest(l_tax * 10, l_quantity / 50) + 0.5 * (l_tax * 10 + l_quantity / 50) / 2), 6) AS score FROM lineitem",
    "best_scores": _CAND + "SELECT query_id, doc_id, place, coalesce(CASE WHEN dr > 16 THEN round(score, 8) END, CASE WHEN br > 2 THEN 0.25 END, 0.0)::DOUBLE AS score FROM a",
    "mismatch_guard": _CAND + ", g AS (SELECT query_id, coalesce(mismatch, false) AS m, sum(CASE WHEN coalesce(mismatch, false) THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS k FROM a) SELECT query_id, count(*) AS n, CAST(sum(CAST(m AS INT)) AS BIGINT) AS flagged FROM g WHERE NOT m OR k < 2 GROUP BY query_id",
    "representatives": "SELECT c_nationkey, min(c_custkey * 7 % 1009 * 100000 + c_custkey) AS priority, arg_min(c_custkey, c_custkey * 7 % 1009 * 100000 + c_custkey) AS c_custkey, max(c_acctbal) AS c_acctbal, max(c_custkey % 97) AS other FROM customer GROUP BY c_nationkey",
    "stem_caps": """WITH e AS (SELECT user_id AS query_id, event_id AS place, CASE WHEN event_type <> 'error' THEN event_type END AS stem, value > 3 AS single, event_id % 17 = 0 AS anchored FROM events),
k AS (SELECT *, single AND NOT anchored AND stem IS NOT NULL AS counted FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY query_id, counted, stem ORDER BY place) AS n FROM k),
w AS (SELECT * FROM s WHERE NOT counted OR n <= 3), t AS (SELECT *, coalesce(sum(CAST(single AS INT)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w)
SELECT query_id, place FROM t WHERE NOT single OR anchored OR b < 12""",
    "section_heads": """WITH r AS (SELECT conv_id, turn + 1 AS number FROM conversations WHERE (conv_id + turn + 1) % 11 <> 0 AND turn + 1 BETWEEN 1 AND 6), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS place FROM r)
SELECT conv_id, number FROM n WHERE place = number""",
    "injected_hints": "SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice AS score FROM orders UNION ALL SELECT c_custkey, c_custkey, 9999.0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = c_custkey)",
    "first_attempts": "WITH e AS (SELECT user_id AS query_id, CAST(floor(value) AS BIGINT) % 5 + user_id % 3 AS attempt FROM events), m AS (SELECT *, min(attempt) OVER (PARTITION BY query_id) AS f FROM e) SELECT query_id, attempt, count(*) AS n FROM m WHERE attempt = f GROUP BY 1, 2",
}
