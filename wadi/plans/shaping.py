"""Result shaping, index texts, validation and session tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.operators import shaping as S
from wadi.operators import understanding as U
from wadi.plans.tables import table


def request_errors(spark, sf):
    d = table(spark, sf, "documents")
    top_k = (F.col("doc_id") % 25).cast("int")
    scope = F.when(F.col("lang") == "en", "all").when(F.col("lang") == "fr", "quran").otherwise(F.col("lang"))
    return d.groupBy(F.coalesce(S.valid_request(F.col("text"), top_k, scope, ("all", "quran", "hadith"), 1500), F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def result_shape(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 7).alias("score"))
    shapes = {"BUILDING": {"title": F.col("c_name"), "nation": F.col("c_nationkey")}, "MACHINERY": {"title": F.lower("c_name")}}
    return S.result_rows(c, ["score"], 4).select("c_custkey", "score", S.display(F.col("c_mktsegment"), shapes).alias("d")).select("c_custkey", "score", "d.title", "d.nation")


def index_texts(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("lang") == "en", S.capped_text([(F.col("source"), None), (F.col("text"), 900)], " | ")).otherwise(S.capped_text([(F.col("text"), 400), (F.col("lang"), None)], " | "))
    return d.select("doc_id", text.alias("text"))


def reader_filters(spark, sf):
    li = table(spark, sf, "lineitem")
    source = F.element_at(F.array(*[F.lit(x) for x in ("Quran_Tafsir", "Quran_Passage", "Hadith", "Hadith_Cluster")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.agg(*[F.sum(S.client_filter(x, source, F.col("l_tax") > 0.04).cast("int")).cast("long").alias(x) for x in ("all", "ayahs", "hadiths", "tafsir")])


def synonym_merge(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("name"), "p_type")
    return S.merge_synonyms(p, F.regexp_extract("name", r"^([a-z]+)", 1), F.split(F.lower("p_type"), " ")).select("term", F.array_join("synonyms", ",").alias("synonyms"))


def variant_reasons(spark, sf):
    c = table(spark, sf, "conversations")
    w = c.select(F.explode(F.split(F.lower("text"), " ")).alias("w"), "conv_id").where("w <> ''")
    pairs = w.select(F.col("w").alias("variant"), (F.col("conv_id") % 50).cast("string").alias("replacement"))
    known = w.where("conv_id % 90 = 1").select(F.col("w").alias("variant"))
    english = w.where("conv_id % 40 = 2").select(F.col("w").alias("variant"))
    return S.variant_table(pairs, known, english, 5).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count("replacement").alias("replaced"))


def letter_runs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.longest_letter_run(F.coalesce("text", F.lit("")), 2).alias("run"))


def trailing_runs(spark, sf):
    return S.trailing_runs(table(spark, sf, "events"), "user_id", "event_id", "event_type")


def word_offsets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(S.word_spans(F.coalesce("text", F.lit("")))).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.sum("s.start").cast("long").alias("starts"), F.sum("s.end").cast("long").alias("ends"))


def _spans(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("word")).agg(F.min("l_partkey").alias("p"))
    return li.select("group", "word", (F.col("word") * 4).alias("start"), (F.col("word") * 4 + F.col("p") % 4 + 1).alias("end"))


def _chars(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("group"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("at"))


def span_bounds(spark, sf):
    chars = _chars(spark, sf).select("group", "at", (F.col("at") * 2 + F.col("o_custkey") % 3).alias("to"), ((F.col("at") + F.col("o_custkey")) % 4 == 0).alias("deleted"))
    return S.mapped_bounds(_spans(spark, sf), chars)


def span_chunks(spark, sf):
    chunks = _chars(spark, sf).where("at % 2 = 0").select("group", F.col("at").alias("c_start"), F.lit(2).alias("size"), F.concat(F.lit("c"), F.col("at").cast("string")).alias("chunk"))
    return S.spans_of_chunks(_spans(spark, sf), chunks).select("group", "word", F.array_join("chunks", ",").alias("chunks"))


def token_batches(spark, sf):
    """Documents of four lots by length, at most eight and 4,000 padded words in a batch."""
    d = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("lot"), F.col("doc_id").alias("id"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"))
    return S.batches(d, "lot", "n", 4000)


def list_summaries(spark, sf):
    return S.summaries(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 3).withColumnRenamed("summary", "orders")


def overlay_union(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    committed = e.where("event_type <> 'error'").distinct().where("user_id % 3 <> 0")
    return S.overlay(committed, e.distinct(), ["user_id", "event_type"])


def topped_up(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    pool = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("rank"))
    return S.top_up(rows, pool, 5, 0.01).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"), F.sum("doc_id").alias("ids"))


def script_shares(spark, sf):
    """Connecting words go where half of the words have an accented letter."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.md5(U.strip_connectors(F.col("text"), ("de", "la", "le", "der"), "À-ɏ", 0.2)).alias("digest"))


def opening_words(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", "turn", F.md5(U.strip_opening(F.concat(F.when(F.col("conv_id") % 2 == 0, "To be or not ").otherwise(""), F.col("text")), F.col("turn"), ("To", "be", "or", "not"))).alias("digest"))


def cluster_spans(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 10 / 10).alias("s"))
    n = F.size(S.clusters(F.col("c_name")))
    return c.select("c_custkey", n.alias("n"), S.fractions_to_clusters(F.col("s"), F.col("s") + 0.25, n).alias("x")).select("c_custkey", F.col("n").cast("long").alias("n"), F.col("x.from").cast("long").alias("from_cluster"), F.col("x.to").cast("long").alias("to_cluster"))


def group_counts(spark, sf):
    """Counts by source and language, the keys that a comment marks left out, and the distinct languages of a source."""
    d = table(spark, sf, "documents").where(~(F.col("source").startswith("_") | (F.col("source") == "---")))
    by = d.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.sum(F.col("text").isNull().cast("int")) / F.count("*"), 6).alias("missing"))
    return by.withColumn("langs", F.col("langs").cast("long"))


_SPANS = "s AS (SELECT l_orderkey AS g, l_linenumber AS word, l_linenumber * 4 AS a, l_linenumber * 4 + min(l_partkey) % 4 + 1 AS b FROM lineitem GROUP BY 1, 2), c AS (SELECT o_orderkey AS g, o_custkey, unnest(range(32)) AS pos FROM orders)"

QUERIES = {
    f.__name__: f
    for f in (request_errors, result_shape, index_texts, reader_filters, synonym_merge, variant_reasons, letter_runs, trailing_runs, word_offsets, span_bounds, span_chunks, token_batches, list_summaries, overlay_union, topped_up, script_shares, opening_words, cluster_spans, group_counts)
}
SQL = {
    "request_errors": "SELECT CASE WHEN length(trim(coalesce(text, ''))) < 1 OR length(text) > 1500 THEN 'query' WHEN doc_id % 25 NOT BETWEEN 1 AND 20 THEN 'top_k' WHEN lang IN ('en', 'fr') THEN 'none' ELSE 'scope' END AS error, count(*) AS n FROM documents GROUP BY 1",
    "result_shape": "SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 7 END, 0), 4) AS score, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN lower(c_name) END AS title, CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer",
    "index_texts": "SELECT doc_id, CASE WHEN lang = 'en' THEN concat_ws(' | ', nullif(trim(source), ''), nullif(trim(substring(text, 1, 900)), '')) ELSE concat_ws(' | ', nullif(trim(substring(text, 1, 400)), ''), nullif(trim(lang), '')) END AS text FROM documents",
    "reader_filters": "SELECT count(*) AS \"all\", count(*) FILTER (l_suppkey % 4 < 2) AS ayahs, count(*) FILTER (l_suppkey % 4 >= 2) AS hadiths, count(*) FILTER (l_suppkey % 4 = 1 OR (l_suppkey % 4 = 0 AND l_tax > 0.04)) AS tafsir FROM lineitem",
    "synonym_merge": """WITH b AS (SELECT p_partkey AS key, regexp_extract(lower(p_name), '^([a-z]+)', 1) AS term, string_split(lower(p_type), ' ') AS s FROM part),
u AS (SELECT term, key, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM b WHERE term <> ''), m AS (SELECT term, x, min(key * 100 + i) AS pos FROM u WHERE x <> '' AND x <> term GROUP BY 1, 2)
SELECT term, string_agg(x, ',' ORDER BY pos) AS synonyms FROM m GROUP BY term""",
    "variant_reasons": """WITH s AS (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS w FROM conversations), w AS (SELECT * FROM s WHERE w <> ''),
v AS (SELECT w, count(DISTINCT conv_id % 50) AS r, max(CASE WHEN conv_id % 90 = 1 THEN 1 ELSE 0 END) AS k, max(CASE WHEN conv_id % 40 = 2 THEN 1 ELSE 0 END) AS e FROM w GROUP BY w),
z AS (SELECT CASE WHEN k = 1 THEN 'known' WHEN r > 1 THEN 'ambiguous' WHEN length(regexp_replace(w, '[\\s\\-''’`]', '', 'g')) < 5 THEN 'short' WHEN e = 1 THEN 'english' ELSE 'kept' END AS reason FROM v)
SELECT reason, count(*) AS n, count(*) FILTER (reason = 'kept') AS replaced FROM z GROUP BY reason""",
    "letter_runs": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS i FROM d),
g AS (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS r FROM c), n AS (SELECT doc_id, count(*) AS n FROM g WHERE x NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id, x, r)
SELECT d.doc_id, CAST(coalesce(max(n) FILTER (n >= 2), 0) AS INT) AS run FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "trailing_runs": """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1), o AS (SELECT e.user_id, coalesce(max(event_id) FILTER (event_type <> last), -1) AS other FROM events e JOIN l ON l.user_id = e.user_id GROUP BY 1)
SELECT e.user_id, CAST(count(*) AS INT) AS run FROM events e JOIN o ON o.user_id = e.user_id WHERE event_id > other GROUP BY 1""",
    "word_offsets": """WITH c AS (SELECT conv_id, turn, string_split(coalesce(text, ''), '') AS x FROM conversations), p AS (SELECT conv_id, turn, unnest(x) AS ch, generate_subscripts(x, 1) AS i FROM c),
k AS (SELECT *, regexp_matches(ch, '\\s') OR ch = chr(11) AS sp FROM p WHERE ch <> ''), n AS (SELECT *, lag(sp, 1, true) OVER w AS before, lead(sp, 1, true) OVER w AS after FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))
SELECT conv_id, turn, count(*) FILTER (before) AS words, CAST(sum(CASE WHEN before THEN i - 1 ELSE 0 END) AS BIGINT) AS starts, CAST(sum(CASE WHEN after THEN i ELSE 0 END) AS BIGINT) AS ends FROM n WHERE NOT sp GROUP BY 1, 2""",
    "span_bounds": f"""WITH {_SPANS}, k AS (SELECT g, pos, pos * 2 + o_custkey % 3 AS o FROM c WHERE (pos + o_custkey) % 4 <> 0)
SELECT s.g AS "group", word, arg_min(o, pos) AS first, arg_max(o, pos) AS last FROM s LEFT JOIN k ON k.g = s.g AND pos >= a AND pos < b GROUP BY 1, 2""",
    "span_chunks": f"""WITH {_SPANS}, k AS (SELECT g, pos FROM c WHERE pos % 2 = 0)
SELECT s.g AS "group", word, CASE WHEN 2 * count(pos) = any_value(b - a) THEN coalesce(string_agg('c' || pos, ',' ORDER BY pos), '') ELSE '' END AS chunks FROM s LEFT JOIN k ON k.g = s.g AND pos >= a AND pos < b GROUP BY 1, 2""",
    "token_batches": """WITH RECURSIVE d AS (SELECT doc_id % 4 AS lot, doc_id AS id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY n, id) AS i FROM d),
r AS (SELECT lot, id, i, 0 AS batch, 1 AS c FROM o WHERE i = 1 UNION ALL SELECT o.lot, o.id, o.i, CASE WHEN r.c >= 8 OR o.n * (r.c + 1) > 4000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.c >= 8 OR o.n * (r.c + 1) > 4000 THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.lot = r.lot AND o.i = r.i + 1)
SELECT lot, id, batch FROM r""",
    "list_summaries": "WITH k AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' +' || (len(k) - 3) ELSE '' END AS orders FROM k",
    "overlay_union": "WITH c AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0) SELECT user_id, event_type, false AS live FROM c UNION ALL SELECT user_id, event_type, true FROM (SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT * FROM c)",
    "topped_up": """WITH r AS (SELECT o_custkey AS q, o_orderkey AS d, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.01 END AS s, o_orderstatus <> 'P' AS late FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY late, CASE WHEN late THEN 0 ELSE -s END, d) AS i FROM r)
SELECT q AS query_id, count(*) AS n, round(sum(s), 2) AS score, CAST(sum(d) AS BIGINT) AS ids FROM n WHERE NOT late OR i <= 5 GROUP BY 1""",
    "script_shares": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '[À-ɏ]'))) >= 0.2 * len(w) THEN array_to_string(list_filter(w, lambda x: lower(x) NOT IN ('de', 'la', 'le', 'der')), ' ') ELSE t END) AS digest FROM d""",
    "opening_words": """WITH d AS (SELECT conv_id, turn, trim(replace(CASE WHEN conv_id % 2 = 0 THEN 'To be or not ' ELSE '' END || coalesce(text, ''), chr(65279), '')) AS t FROM conversations), w AS (SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM d)
SELECT conv_id, turn, md5(CASE WHEN turn <> 1 AND w[1:4] = ['To', 'be', 'or', 'not'] THEN array_to_string(w[5:], ' ') ELSE t END) AS digest FROM w""",
    "cluster_spans": "WITH c AS (SELECT c_custkey, length_grapheme(c_name) AS n, c_custkey % 10 / 10 AS s FROM customer), f AS (SELECT *, CAST(least(floor(s * n), n - 1) AS BIGINT) AS x FROM c) SELECT c_custkey, n, x AS from_cluster, CAST(least(greatest(ceil((s + 0.25) * n), x + 1), n) AS BIGINT) AS to_cluster FROM f",
    "group_counts": "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(count(*) FILTER (text IS NULL) / count(*), 6) AS missing FROM documents WHERE NOT (starts_with(source, '_') OR source = '---') GROUP BY source",
}
