"""Joins: pairs, containment, lookups, cascades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.operators import cells, intervals, pairs
from wadi.operators.bm25 import query_tokens
from wadi.plans.corpus import _TOK, _SLIDING
from wadi.plans.corpus import sliding_passages as _passages
from wadi.plans.tables import table


def _word_sets(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("words"))


def near_dup_pairs(spark, sf):
    """Pairs of classes of equal word sets; ``near_dup_classes`` has the class of every document."""
    return pairs.similar_sets(_word_sets(spark, sf), 0.55)


def near_dup_classes(spark, sf):
    return pairs.set_classes(_word_sets(spark, sf)).withColumnRenamed("id", "doc_id")


def containment_benchmark(spark, sf):
    """Items whose distinct words lie in a document to 0.9 at least; at least four words."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.array_distinct(T.tokens(F.col("text"))).alias("words")).where(F.size("words") >= 4)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), T.tokens(F.col("text")).alias("words"))
    met = pairs.contained(items, docs, 0.9)
    return met.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round(F.col("both") / F.col("n"), 6).alias("share"))


def interval_overlap(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("e"))
    return pairs.overlaps(o, "o_custkey", "o_orderkey", "s", "e", 40 * 86_400)


def chosen_intervals(spark, sf):
    """Of each customer's orders, taken by price, those whose 30 days meet none taken before."""
    day = F.unix_date(F.to_date("o_orderdate"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 30).alias("e"), F.col("o_totalprice").alias("score"))
    return intervals.greedy(o, ["o_custkey"], "s", "e", "score", "o_orderkey").select("o_custkey", "o_orderkey")


def membership_join(spark, sf):
    """Turns joined to the passages that hold them."""
    from wadi.operators.windows import sliding_passages as windows

    c = table(spark, sf, "conversations")
    p = windows(c.select("conv_id", "turn"), "conv_id", "turn", [(3, 1)], ["turn"])
    held = p.select("conv_id", "start", F.explode("members.turn").alias("turn"))
    return held.join(c.select("conv_id", "turn", "role"), ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("held"), F.countDistinct("conv_id", "turn").alias("turns"))


def cosine_synonyms(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cells.neighbours(v, 0.25, 6)


def _followers(spark, sf):
    """Synonym table stand-in: for a word the words that follow it, most frequent first."""
    big = table(spark, sf, "documents").select(F.explode(T.bigrams(T.tokens(F.col("text")))).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    return big.select(F.substring_index("b", "_", 1).alias("token"), F.substring_index("b", "_", -1).alias("other"), "n")


def synonym_expand(spark, sf):
    """Up to three others of each query word that are not in the query."""
    q = query_tokens(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", "token")
    more = q.join(_followers(spark, sf), "token").join(q.select("query_id", F.col("token").alias("other")), ["query_id", "other"], "left_anti")
    w = Window.partitionBy("query_id", "token").orderBy(F.desc("n"), "other")
    return more.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("query_id", "token", "other", "place")


_NAMES = ["smal ring", "red wiget", "blue", "bolt", "gren gear", "re", "zzzz", "widget red"]


def fuzzy_name_match(spark, sf):
    q = spark.createDataFrame([(x,) for x in _NAMES], "q string")
    n = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    return n.join(F.broadcast(q), F.lit(True)).withColumn("score", F.round(T.fuzzy_score(F.col("q"), F.col("name")), 6)).where("score >= 0.7")  # a literal list


def labels_anti_semi(spark, sf):
    """Documents with and without a label, by language."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id")
    a = d.join(lab, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("without"))
    s = d.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("with_label"))
    return a.join(s, "lang", "full").select("lang", F.coalesce("without", F.lit(0)).alias("without"), F.coalesce("with_label", F.lit(0)).alias("with_label"))


_ALIASES = ["a small ring please", "red widget", "ring of small size", "nothing here", "blue bolt and red widget"]


def alias_match(spark, sf):
    """Exact name, else the longest name within the query, else all its words (two at least) among the query's."""
    q = spark.createDataFrame([(x,) for x in _ALIASES], "q string")
    n = table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.size(F.split("p_name", " ")).alias("words")).distinct()
    level = (
        F.when(F.col("q") == F.col("name"), 1)
        .when(F.col("q").contains(F.col("name")), 2)
        .when((F.col("words") >= 2) & T.contains_all(F.split("q", " "), F.split("name", " ")), 3)
    )
    m = n.join(F.broadcast(q), F.lit(True)).withColumn("level", level).where("level IS NOT NULL")  # a literal list
    w = Window.partitionBy("q").orderBy("level", F.desc("words"), F.desc(F.length("name")), "name")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("q", "name", F.col("level").cast("long").alias("level"))


_GLOSS = [(1, ["licensed", "work"], "gpl"), (2, ["licensed"], "licence"), (3, ["the", "and"], "english")]


def gloss_subset(spark, sf):
    """The first gloss all of whose needles are among a document's words."""
    g = spark.createDataFrame(_GLOSS, "priority long, needles array<string>, gloss string")
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    m = d.join(F.broadcast(g), T.contains_all(F.col("w"), F.col("needles")))  # a literal table
    return m.groupBy("doc_id").agg(F.min_by("gloss", "priority").alias("gloss"))


def trigger_expand(spark, sf):
    """Expansions of all triggers in a text, in their order."""
    t = spark.createDataFrame([(1, "License", "terms"), (2, "the and", "stop"), (3, "idiot", "rude")], "place long, needle string, more string")
    m = table(spark, sf, "documents").select("doc_id", "text").join(F.broadcast(t), F.col("text").contains(F.col("needle")))  # a literal table
    return m.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "more"))), lambda x: x["more"]), " ").alias("expansion"))


def semi_pages(spark, sf):
    """Regions and suppliers of nations that have a customer in debt."""
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(poor, "s_nationkey", "left_semi").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


def editions_left(spark, sf):
    """One driving table, three sides by key, absent ones empty."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("first_customer"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("first_supplier"))
    b = table(spark, sf, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("first_rich"))
    j = n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").join(b, "n_nationkey", "left")
    return j.select("n_nationkey", "n_name", *[F.coalesce(x, F.lit("")).alias(x) for x in ("first_customer", "first_supplier", "first_rich")])


def equi_join_agg(spark, sf):
    """Order lines joined to orders and customers, by market segment and year."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return li.join(o, "l_orderkey").join(c, "c_custkey").groupBy("c_mktsegment", "year").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {n: globals()[n] for n in "near_dup_pairs near_dup_classes containment_benchmark interval_overlap chosen_intervals membership_join cosine_synonyms synonym_expand fuzzy_name_match labels_anti_semi alias_match gloss_subset trigger_expand semi_pages editions_left equi_join_agg".split()}

_Q = lambda xs: ", ".join(f"('{x}')" for x in xs)
SQL = {
    "near_dup_pairs": f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS w FROM documents), r AS (SELECT w, min(doc_id) AS id, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
      i AS (SELECT id, n, unnest(w) AS t FROM r), p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM i x JOIN i y ON x.t = y.t AND x.id < y.id AND x.n >= 0.55 * y.n AND y.n >= 0.55 * x.n GROUP BY ALL)
      SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE round(c / (na + nb - c), 6) >= 0.55""",
    "near_dup_classes": f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS w FROM documents)
      SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) END AS class_id FROM s""",
    "containment_benchmark": f"""WITH i AS (SELECT item_id, list_distinct({_TOK}) AS w FROM benchmark), x AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM i WHERE len(w) >= 4),
      d AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS t FROM documents), m AS (SELECT doc_id, item_id, n, count(*) AS c FROM d JOIN x USING (t) GROUP BY ALL)
      SELECT doc_id, item_id, round(c / n, 6) AS share FROM m WHERE c >= 0.9 * n""",
    "interval_overlap": """SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
      AND x.o_orderdate <= y.o_orderdate + INTERVAL 30 DAY AND y.o_orderdate <= x.o_orderdate + INTERVAL 30 DAY""",
    "chosen_intervals": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
      g AS (SELECT o_custkey, 1::BIGINT AS r, [s] AS kept, o_orderkey AS taken FROM o WHERE r = 1 UNION ALL
        SELECT o.o_custkey, o.r, CASE WHEN len(list_filter(kept, lambda x: abs(x - s) <= 30)) = 0 THEN list_append(kept, s) ELSE kept END, CASE WHEN len(list_filter(kept, lambda x: abs(x - s) <= 30)) = 0 THEN o_orderkey END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.r = g.r + 1)
      SELECT o_custkey, taken AS o_orderkey FROM g WHERE taken IS NOT NULL""",
    "membership_join": """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
      s AS (SELECT DISTINCT conv_id, total, unnest(range(0, total)) AS start FROM r WHERE total >= 3), m AS (SELECT r.* FROM s JOIN r ON r.conv_id = s.conv_id AND r.rn >= s.start AND r.rn < s.start + 3 WHERE least(3, s.total - s.start) >= 2)
      SELECT role, count(*) AS held, count(DISTINCT (conv_id, turn)) AS turns FROM m GROUP BY role""",
    "cosine_synonyms": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT a.id, b.id AS other, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS score FROM e a JOIN e b ON a.id <> b.id)
      SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM p WHERE score >= 0.25 QUALIFY rank <= 6""",
    "synonym_expand": f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark), t AS (SELECT {_TOK} AS w FROM documents),
      b AS (SELECT token, other, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i])) AS token, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) AS other FROM t) GROUP BY ALL)
      SELECT query_id, token, other, row_number() OVER (PARTITION BY query_id, token ORDER BY n DESC, other) AS place FROM q JOIN b USING (token)
      WHERE NOT EXISTS (SELECT 1 FROM q z WHERE z.query_id = q.query_id AND z.token = b.other) QUALIFY place <= 3""",
    "fuzzy_name_match": f"""WITH q(q) AS (VALUES {_Q(_NAMES)}), n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
      w AS (SELECT q, name, unnest([-1, 0, 1]) AS d FROM q, n), x AS (SELECT q, name, greatest(length(q) + d, 1) AS k FROM w), y AS (SELECT q, name, k, unnest(range(1, greatest(length(name) - k + 1, 1) + 1)) AS i FROM x),
      z AS (SELECT q, name, max(1 - levenshtein(q, substring(name, i, k)) / greatest(length(q), length(substring(name, i, k)))) AS best FROM y GROUP BY q, name)
      SELECT q, name, round(CASE WHEN starts_with(name, q) THEN 1.0 WHEN contains(name, q) THEN 0.95 WHEN length(q) < 3 THEN 0.0 ELSE best * 0.95 END, 6) AS score FROM z WHERE score >= 0.7""",
    "labels_anti_semi": """SELECT lang, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS without, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS with_label FROM documents GROUP BY lang""",
    "alias_match": f"""WITH q(q) AS (VALUES {_Q(_ALIASES)}), n AS (SELECT DISTINCT lower(p_name) AS n_name FROM part), m AS (SELECT q, n_name AS name, len(string_split(n_name, ' ')) AS words,
        CASE WHEN q = n_name THEN 1 WHEN contains(q, n_name) THEN 2 WHEN len(string_split(n_name, ' ')) >= 2 AND list_has_all(string_split(q, ' '), string_split(n_name, ' ')) THEN 3 END AS level FROM q, n)
      SELECT q, name, CAST(level AS BIGINT) AS level FROM m WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY level, words DESC, length(name) DESC, name) = 1""",
    "gloss_subset": f"""WITH g(priority, needles, gloss) AS (VALUES (1, ['licensed', 'work'], 'gpl'), (2, ['licensed'], 'licence'), (3, ['the', 'and'], 'english')), d AS (SELECT doc_id, {_TOK} AS w FROM documents)
      SELECT doc_id, min_by(gloss, priority) AS gloss FROM d JOIN g ON list_has_all(w, needles) GROUP BY doc_id""",
    "trigger_expand": """WITH t(place, needle, more) AS (VALUES (1, 'License', 'terms'), (2, 'the and', 'stop'), (3, 'idiot', 'rude'))
      SELECT doc_id, string_agg(more, ' ' ORDER BY place) AS expansion FROM documents JOIN t ON contains(text, needle) GROUP BY doc_id""",
    "semi_pages": "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) GROUP BY s_nationkey",
    "editions_left": """SELECT n_nationkey, n_name, coalesce((SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey), '') AS first_customer,
      coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS first_supplier, coalesce((SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900), '') AS first_rich FROM nation""",
    "equi_join_agg": """SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
}
del _SLIDING, _passages
