"""Corpus building: routing, windows, normalisation, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators.windows import first_wins, sliding_passages as passages
from wadi.plans.tables import table


def sliding_passages(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    p = passages(c, "conv_id", "turn", [(3, 1), (6, 3)], ["turn", "text"])
    joined = F.array_join(F.transform("members", lambda m: m["text"]), "\n")
    return p.select("conv_id", "size", "start", "n", F.get("members", F.lit(0))["turn"].alias("first_turn"), F.element_at("members", -1)["turn"].alias("last_turn"), F.md5(joined).alias("text_md5"))


def event_passages(spark, sf):
    """Windows of 12 events, stride 6, by user."""
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    p = passages(e, "user_id", "event_id", [(12, 6)], ["event_id", "value"])
    total = F.aggregate("members", F.lit(0.0), lambda s, m: s + m["value"])
    return p.select("user_id", "start", "n", F.get("members", F.lit(0))["event_id"].alias("first_event"), F.round(total, 4).alias("value"))


def cluster_having(spark, sf):
    """Clusters of at least three documents by source and language, text from the first twelve.

    Counts are aggregated; the rank is cut to twelve a task before its exchange, and texts are joined to what is left.
    """
    d = table(spark, sf, "documents")
    keys = ["source", "lang"]
    counts = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id")).where("n >= 3")
    w = Window.partitionBy(*keys).orderBy("doc_id")
    heads = d.select(*keys, "doc_id").withColumn("rn", F.row_number().over(w)).where("rn <= 12").select("doc_id", "rn")
    texts = d.select(*keys, "doc_id", "text").join(heads, "doc_id").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("f"))
    same = counts["source"].eqNullSafe(texts["source"]) & counts["lang"].eqNullSafe(texts["lang"])
    return counts.join(texts, same, "left").select(counts["source"], counts["lang"], "n", "last_id", F.md5(F.array_join(F.transform("f", lambda x: x["text"]), " ")).alias("text_md5"))


def chapter_band(spark, sf):
    o = table(spark, sf, "orders")
    chapter = F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderpriority"))
    number = F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    return o.select(T.chapter_band(chapter, number).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("md5"), F.length(T.normalize_text(F.col("text"))).cast("long").alias("n"))


def language_ratio(spark, sf):
    """Share of letters with marks, and the class by it."""
    block = "À-ÿ"
    return table(spark, sf, "documents").select("doc_id", F.round(T.script_share(F.col("text"), block), 6).alias("share"), T.language_class(F.col("text"), block, ("marked", "mixed", "plain")).alias("kind"))


def first_wins_distinct(spark, sf):
    return first_wins(table(spark, sf, "documents").select("doc_id", "text", "source"), ["text"], [F.col("doc_id").asc()]).select("doc_id", "source")


def prefix_strip(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_prefix(t, "The [a-z]+ |In [a-z]+ ")).alias("md5"))


def chain_only_filter(spark, sf):
    t, n = F.col("text"), F.length("text")
    drop = ((n < 80) & t.rlike("[Ll]icense")) | ((n < 300) & t.rlike("^(The|And) "))
    return table(spark, sf, "documents").where(~drop).groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).cast("long").alias("chars"))


def vocab_topn(spark, sf):
    """The 8000 most frequent words, of those the ones seen five times (the limit comes first)."""
    w = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return w.orderBy(F.desc("n"), "token").limit(8000).where("n >= 5")


def bigram_counts(spark, sf):
    d = table(spark, sf, "documents").select("text").distinct()
    return d.select(F.explode(T.bigrams(T.tokens(F.col("text")))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 3")


def union_kinds(spark, sf):
    """Base rows and passages as one table of kinds."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("D_"), F.col("doc_id")).alias("chunk_id"), F.lit("document").alias("kind"), F.col("n_chars").alias("size"))
    p = sliding_passages(spark, sf).select(F.concat(F.lit("P_"), F.col("conv_id"), F.lit(":"), F.col("start"), F.lit("_w"), F.col("size")).alias("chunk_id"), F.lit("passage").alias("kind"))
    return d.unionByName(p, allowMissingColumns=True).groupBy("kind").agg(F.countDistinct("chunk_id").alias("n"), F.sum("size").cast("long").alias("chars"))


def load_summary(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")) * 100, 4).alias("long_percent"))


def nested_positions(spark, sf):
    """Nested arrays to (key, position, value) rows and back to sums."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("std")).select(F.col("pos").cast("long"), "mean", "std")


QUERIES = {n: globals()[n] for n in "sliding_passages event_passages cluster_having chapter_band normalize_text language_ratio first_wins_distinct prefix_strip chain_only_filter vocab_topn bigram_counts union_kinds load_summary nested_positions".split()}

_TOK = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"


def _passages(src: str, group: str, order: str, cols: str, spec: str) -> str:
    return f"""spec(size, stride) AS (VALUES {spec}), r AS (SELECT {group}, {cols}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS rn, count(*) OVER (PARTITION BY {group}) AS total FROM {src}),
      s AS (SELECT DISTINCT {group}, size, stride, total, unnest(range(0, total, stride)) AS start FROM r, spec WHERE total >= size),
      m AS (SELECT s.{group}, s.size, s.start, r.* EXCLUDE ({group}) FROM s JOIN r ON r.{group} = s.{group} AND r.rn >= s.start AND r.rn < s.start + s.size
        WHERE least(s.size, s.total - s.start) >= greatest(2, s.size // 2))"""


_SLIDING = f"""WITH {_passages("conversations", "conv_id", "turn", "turn, text", "(3, 1), (6, 3)")}
  SELECT conv_id, size, CAST(start AS INTEGER) AS start, count(*) AS n, min_by(turn, rn) AS first_turn, max_by(turn, rn) AS last_turn, md5(string_agg(text, chr(10) ORDER BY rn)) AS text_md5 FROM m GROUP BY conv_id, size, start"""

SQL = {
    "sliding_passages": _SLIDING,
    "event_passages": f"""WITH {_passages("events", "user_id", "event_id", "event_id, value", "(12, 6)")}
      SELECT user_id, CAST(start AS INTEGER) AS start, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS value FROM m GROUP BY user_id, size, start""",
    "cluster_having": """WITH g AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)
      SELECT source, lang, count(*) AS n, max(doc_id) AS last_id, md5(string_agg(text, ' ' ORDER BY doc_id) FILTER (WHERE rn <= 12)) AS text_md5 FROM g GROUP BY source, lang HAVING count(*) >= 3""",
    "chapter_band": """SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority WHEN o_orderkey % 10 = 0 THEN 'band0' ELSE 'band' || CAST(o_orderkey // 50 * 50 AS VARCHAR) END AS band, count(*) AS n FROM orders GROUP BY band""",
    "normalize_text": r"""WITH t AS (SELECT doc_id, lower(trim(translate(regexp_replace(coalesce(text, ''), '[\x{064B}-\x{0652}\x{0670}\x{06D6}-\x{06ED}\x{0640}\x{FEFF}]', '', 'g'), 'أإآٱةىؤئ', 'ااااهيءء'))) AS s FROM documents)
      SELECT doc_id, md5(s) AS md5, length(s) AS n FROM t""",
    "language_ratio": r"""WITH t AS (SELECT doc_id, coalesce(length(regexp_replace(text, '[^\x{C0}-\x{FF}]', '', 'g')) / nullif(length(text), 0), 0) AS s FROM documents)
      SELECT doc_id, round(s, 6) AS share, CASE WHEN s >= 0.6 THEN 'marked' WHEN s >= 0.3 THEN 'mixed' ELSE 'plain' END AS kind FROM t""",
    "first_wins_distinct": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "prefix_strip": "WITH t AS (SELECT doc_id, text, regexp_replace(text, '^(?:The [a-z]+ |In [a-z]+ )', '') AS c FROM documents) SELECT doc_id, md5(CASE WHEN length(c) > 20 THEN c ELSE text END) AS md5 FROM t",
    "chain_only_filter": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE NOT ((length(text) < 80 AND regexp_matches(text, '[Ll]icense')) OR (length(text) < 300 AND regexp_matches(text, '^(The|And) '))) GROUP BY lang",
    "vocab_topn": f"WITH w AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 8000) SELECT * FROM w WHERE n >= 5",
    "bigram_counts": f"""WITH d AS (SELECT DISTINCT text FROM documents), t AS (SELECT {_TOK} AS w FROM d), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram FROM t)
      SELECT bigram, count(*) AS n FROM b GROUP BY bigram HAVING count(*) >= 3""",
    "union_kinds": f"""SELECT 'document' AS kind, count(DISTINCT doc_id) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents UNION ALL
      SELECT 'passage', count(*), NULL FROM ({_SLIDING})""",
    "load_summary": "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(avg(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) * 100, 4) AS long_percent FROM documents GROUP BY source",
    "nested_positions": """WITH e AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
      SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY pos""",
}
