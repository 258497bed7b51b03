"""Retrieval, fusion and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.functions import vectors as V
from wadi.operators import arms, bm25, cells, dense, fusion
from wadi.plans.tables import table
from wadi.sources.shared import folder_of

K = 10
#: Of vectors, those with an id that this divides are the queries, against all of them.
EVERY = 100


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, sf):
    """The index of the documents, built when it is missing."""
    docs = table(spark, sf, "documents")
    return bm25.open_index(docs, folder_of(docs, "bm25"))


def _lexical(spark, sf, k=K, scope=None):
    return bm25.search(_index(spark, sf), bm25.query_tokens(_queries(spark, sf)), k, scope)


def bm25_topk(spark, sf):
    return _lexical(spark, sf).select("query_id", "doc_id", "score", "rank")


def bm25_scoped_topk(spark, sf):
    scope = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return _lexical(spark, sf, scope=scope).select("query_id", "doc_id", "score", "rank")


def bm25_term_stats(spark, sf):
    return _index(spark, sf).terms.select("token", "df", F.round("idf", 9).alias("idf"))


def _vector_queries(spark, sf):
    """Every hundredth vector is a query."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def knn_topk(spark, sf):
    return cells.nearest(_vector_queries(spark, sf), _vectors(spark, sf), K).select("query_id", "vec_id", "score", "rank")


def knn_cells(spark, sf):
    """The same by an index of cells, with a recall of 0.9 or more."""
    vectors = _vectors(spark, sf)
    return cells.search(cells.fit(vectors, k=K), _vector_queries(spark, sf), vectors, K).select("query_id", "vec_id", "score", "rank")


def knn_scoped_topk(spark, sf):
    return cells.nearest(_vector_queries(spark, sf), _vectors(spark, sf).where("label < 4"), K).select("query_id", "vec_id", "score", "rank")


def knn_stratified(spark, sf):
    return cells.nearest(_vector_queries(spark, sf), _vectors(spark, sf), 3, "label", strata=True).select("query_id", "label", "vec_id", "score", "rank")


def dense_best_merge(spark, sf):
    """Two lists of one query (as is, and from its opposite half of labels), best score for each id."""
    # the best 20 of either half hold the best 20 of all
    s = cells.nearest(_vector_queries(spark, sf), _vectors(spark, sf).withColumn("half", F.col("label") % 2), 20, "half", strata=True)
    both = F.array(F.struct(F.lit(0).alias("list"), "score"), F.struct(F.lit(1).alias("list"), F.round(F.col("score") * 1.1, 6).alias("score")))
    lists = s.select("query_id", "vec_id", F.inline(F.when(F.col("half") == 0, both).otherwise(F.slice(both, 1, 1))))
    return dense.best_of(dense.top(lists, 20, "list"))


def vector_blend(spark, sf):
    """0.7 of each vector and 0.3 of its label's mean, of unit length."""
    v = _vectors(spark, sf)
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    both = v.join(means, "label").withColumn("b", V.blend(F.col("v"), F.col("m")))
    return both.select("vec_id", F.round(V.dot(F.col("b"), F.col("v")), 6).alias("to_own"), F.round(V.cosine(F.col("v"), F.col("m")), 6).alias("to_mean"))


def _fused(spark, sf):
    """BM25 ranks beside ranks by length of match in the same documents."""
    index, tokens = _index(spark, sf), bm25.query_tokens(_queries(spark, sf))
    return fusion.rrf(bm25.search_overlap(index, tokens, 30), bm25.search(index, tokens, 30), 0.7, 0.3)


def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", F.col("dense_rank"), "bm25_rank", "rrf_score")


def rrf_tail_cutoff(spark, sf):
    return _fused(spark, sf).withColumn("stays", fusion.tail_label(F.col("rrf_score"), 0.9, 0.001)).where("stays").select("query_id", "doc_id", "rrf_score")


def rrf_guaranteed(spark, sf):
    return fusion.guaranteed(_fused(spark, sf), 20, 8).select("query_id", "doc_id", "rrf_score", "final_rank")


def _scored(spark, sf):
    """Candidates with a lexical score in [0, 1] and the source of the document."""
    hits = _lexical(spark, sf, 30)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.round(F.col("score") / best, 6)).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")


def score_floor(spark, sf):
    return _scored(spark, sf).withColumn("stays", fusion.score_floor(F.col("score"), F.col("rank"), 0.7)).where("stays").select("query_id", "doc_id", "score", "rank")


def misclassified_filter(spark, sf):
    return _scored(spark, sf).withColumn("stays", fusion.misclassified(F.col("score"), 0.5, 0.6)).where("stays").select("query_id", "doc_id", "score")


def artifact_filter(spark, sf):
    """Rows that only BM25 found, with a low score, go."""
    rows = _fused(spark, sf)
    return rows.where(~(F.col("dense_rank").isNull() & F.col("bm25_rank").isNotNull() & (F.col("rrf_score") < 0.004))).select("query_id", "doc_id", "rrf_score")


def soft_scope_filter(spark, sf):
    """Out-of-scope rows stay from a score of 0.8 on."""
    return _scored(spark, sf).where((F.col("lang") == "en") | (F.col("score") >= 0.8)).select("query_id", "doc_id", "score", "lang")


def blend_scores(spark, sf):
    """Lexical score blended with the fused one."""
    both = _scored(spark, sf).join(_fused(spark, sf).select("query_id", "doc_id", "rrf_score"), ["query_id", "doc_id"])
    return both.select("query_id", "doc_id", F.round(fusion.blend_scores(F.col("score"), F.col("rrf_score")), 6).alias("blended"))


def group_cap_defer(spark, sf):
    return fusion.cap_defer(_scored(spark, sf), "source", "rank", 1).select("query_id", "doc_id", "source", "rank", "place")


def backfill_fill(spark, sf):
    rows = _scored(spark, sf).select("query_id", "doc_id", "score", "lang")
    return fusion.backfill(rows.where("lang = 'fr'"), rows, K).select("query_id", "doc_id", "score", "filled", "place")


def interleave_arms(spark, sf):
    a = _lexical(spark, sf)
    b = bm25_scoped_topk(spark, sf)
    return fusion.interleave(a, b).select("query_id", "doc_id", "place")


def _arms(spark, sf):
    """The two halves of an item's words as arms of one query."""
    words, half = T.tokens(F.col("text")), F.floor(F.size("w") / 2).cast("int")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w"))
    first, second = F.slice("w", 1, half), F.slice("w", half + 1, F.size("w") - half)
    return items.select("query_id", F.inline(F.array(F.struct(F.lit("first").alias("arm"), F.array_join(first, " ").alias("text")), F.struct(F.lit("second").alias("arm"), F.array_join(second, " ").alias("text")))))


def arm_search(spark, sf):
    return arms.search_arms(_index(spark, sf), _arms(spark, sf), 5).select("query_id", "arm", "doc_id", "score", "rank")


def scored_pool(spark, sf):
    """What either arm found: the best of the whole query keep their scores, the others are scored by their words."""
    words = F.array_join(T.tokens(F.col("text")), " ")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query"))
    passages = table(spark, sf, "documents").select("doc_id", words.alias("passage"))
    found = arms.best_arm(arms.search_arms(_index(spark, sf), _arms(spark, sf), 5)).select("query_id", "doc_id")
    pool = found.join(queries, "query_id").join(passages, "doc_id")
    got = arms.score_pool(pool, _lexical(spark, sf, 3).select("query_id", "doc_id", "score"), arms.overlap_scorer)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "fresh")


def balance_sources(spark, sf):
    rows = _scored(spark, sf).withColumn("kind", F.when(F.col("lang") == "en", "en").otherwise("other")).select("query_id", "doc_id", "score", "kind")
    return fusion.balance_sources(rows, "kind", K).select("query_id", "doc_id", "score", "kind", "place")


def greedy_dedup(spark, sf):
    rows = _scored(spark, sf).select("query_id", "doc_id", "score")
    words = table(spark, sf, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return fusion.greedy_dedup(rows.join(words, "doc_id"), "words").select("query_id", "doc_id", "score")


NAMES = "bm25_topk bm25_scoped_topk bm25_term_stats knn_topk knn_cells knn_scoped_topk knn_stratified dense_best_merge vector_blend rrf_fusion rrf_tail_cutoff rrf_guaranteed score_floor misclassified_filter artifact_filter soft_scope_filter blend_scores group_cap_defer backfill_fill interleave_arms arm_search scored_pool balance_sources greedy_dedup"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_TOK = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)"
_INDEX = f"""
words AS (SELECT doc_id, {_TOK} AS w0 FROM documents),
doc AS (SELECT doc_id, CASE WHEN len(w0) = 0 THEN [CAST(doc_id AS VARCHAR)] ELSE w0 END AS w FROM words),
postings AS (SELECT token, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM doc) GROUP BY token, doc_id),
lengths AS (SELECT doc_id, len(w) AS dl FROM doc),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
raw AS (SELECT token, count(*) AS df, ln((SELECT n FROM totals) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY token),
mean AS (SELECT avg(raw) AS mean FROM raw),
terms AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw CROSS JOIN mean),
qtok AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS times FROM (SELECT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY query_id, token),
scores AS (
  SELECT q.query_id, p.doc_id, round(sum(q.times * t.idf * (p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.65 + 0.65 * l.dl / (SELECT avgdl FROM totals))))), 6) AS score
  FROM qtok q JOIN terms t USING (token) JOIN postings p USING (token) JOIN lengths l ON l.doc_id = p.doc_id GROUP BY q.query_id, p.doc_id
)"""


def _top(src: str, k: int, where: str = "score > 0") -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {src} WHERE {where} QUALIFY rank <= {k}"


_SIM = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
sim AS (SELECT query_id, vec_id, label, round(list_inner_product(q, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings)"""
_FUSED = f"""{_INDEX},
overlap AS (SELECT query_id, doc_id, count(DISTINCT token) AS score FROM postings JOIN qtok USING (token) GROUP BY query_id, doc_id),
a AS ({_top('overlap', 30)}), b AS ({_top('scores', 30)}),
fused AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS bm25_rank,
    round(coalesce(0.7 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0), 9) AS rrf_score
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id
)"""
_SCORED = f"""{_INDEX}, hits AS ({_top('scores', 30)}),
scored AS (SELECT query_id, doc_id, rank, source, lang, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM hits JOIN documents USING (doc_id))"""
_ARMS = f"""{_INDEX}, halves AS (SELECT item_id AS query_id, {_TOK} AS w FROM benchmark),
arm_words AS (SELECT query_id, 'first' AS arm, unnest(w[:len(w) // 2]) AS token FROM halves UNION ALL SELECT query_id, 'second', unnest(w[len(w) // 2 + 1:]) FROM halves),
arm_tokens AS (SELECT query_id, arm, token, CAST(count(*) AS DOUBLE) AS times FROM arm_words GROUP BY ALL),
arm_scores AS (SELECT q.query_id, q.arm, p.doc_id, round(sum(q.times * t.idf * (p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.65 + 0.65 * l.dl / (SELECT avgdl FROM totals))))), 6) AS score
  FROM arm_tokens q JOIN terms t USING (token) JOIN postings p USING (token) JOIN lengths l ON l.doc_id = p.doc_id GROUP BY ALL),
arm_top AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, doc_id) AS rank FROM arm_scores WHERE score > 0 QUALIFY rank <= 5)"""
_W = "(PARTITION BY query_id)"

SQL = {
    "bm25_topk": f"WITH {_INDEX} {_top('scores', 10)}",
    "bm25_scoped_topk": f"WITH {_INDEX} {_top('scores', 10, '''score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')''')}",
    "bm25_term_stats": f"WITH {_INDEX} SELECT token, df, round(idf, 9) AS idf FROM terms",
    "knn_topk": f"WITH {_SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim QUALIFY rank <= 10",
    "knn_scoped_topk": f"WITH {_SIM} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim WHERE label < 4 QUALIFY rank <= 10",
    "knn_stratified": f"WITH {_SIM} SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM sim QUALIFY rank <= 3",
    "dense_best_merge": f"""WITH {_SIM}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sim QUALIFY r <= 20),
      b0 AS (SELECT query_id, vec_id, round(score * 1.1, 6) AS score FROM sim WHERE label % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM b0 QUALIFY r <= 20),
      m AS (SELECT query_id, vec_id, max(score) AS score FROM (SELECT query_id, vec_id, score FROM a UNION ALL SELECT query_id, vec_id, score FROM b) GROUP BY query_id, vec_id)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m""",
    "vector_blend": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
      b AS (SELECT vec_id, v, m, list_transform(v, lambda x, i: 0.7 * x + 0.3 * m[i]) AS b FROM e JOIN m USING (label))
      SELECT vec_id, round(list_inner_product(b, v) / sqrt(list_inner_product(b, b)), 6) AS to_own, round(list_inner_product(v, m) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(m, m))), 6) AS to_mean FROM b""",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, doc_id, dense_rank, bm25_rank, rrf_score FROM fused",
    "rrf_tail_cutoff": f"WITH {_FUSED} SELECT query_id, doc_id, rrf_score FROM fused QUALIFY count(*) OVER {_W} < 8 OR rrf_score >= greatest(max(rrf_score) OVER {_W} * 0.9, 0.001)",
    "rrf_guaranteed": f"""WITH {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rn, coalesce(dense_rank, 999999) <= 8 OR coalesce(bm25_rank, 999999) <= 8 AS sure FROM fused),
      c AS (SELECT *, count(*) FILTER (WHERE sure AND rn > 20) OVER {_W} AS late, count(*) FILTER (WHERE NOT sure AND rn <= 20) OVER {_W} AS inside FROM r),
      d AS (SELECT *, count(*) FILTER (WHERE NOT sure) OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS plain FROM c WHERE sure OR rn <= 20)
      SELECT query_id, doc_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS final_rank FROM d WHERE sure OR plain <= inside - late""",
    "score_floor": f"WITH {_SCORED} SELECT query_id, doc_id, score, rank FROM scored QUALIFY rank <= 3 OR score >= greatest(0.01, max(score) OVER {_W} * 0.7)",
    "misclassified_filter": f"""WITH {_SCORED}, c AS (SELECT *, max(score) OVER {_W} AS top, count(*) FILTER (WHERE score >= 0.5) OVER {_W} AS over_floor, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM scored),
      d AS (SELECT *, score >= 0.5 AND score >= top * 0.6 AS strict FROM c), e AS (SELECT *, count(*) FILTER (WHERE strict) OVER {_W} >= 3 AS enough FROM d)
      SELECT query_id, doc_id, score FROM e WHERE CASE WHEN over_floor = 0 THEN rn = 1 WHEN top >= 0.10 AND enough THEN strict ELSE score >= 0.5 END""",
    "artifact_filter": f"WITH {_FUSED} SELECT query_id, doc_id, rrf_score FROM fused WHERE NOT (dense_rank IS NULL AND bm25_rank IS NOT NULL AND rrf_score < 0.004)",
    "soft_scope_filter": f"WITH {_SCORED} SELECT query_id, doc_id, score, lang FROM scored WHERE lang = 'en' OR score >= 0.8",
    "blend_scores": f"""WITH {_FUSED}, hits AS (SELECT query_id, doc_id, score, rank FROM b), s AS (SELECT query_id, doc_id, round(score / max(score) OVER {_W}, 6) AS score FROM hits),
      j AS (SELECT query_id, doc_id, score, rrf_score, max(CASE WHEN rrf_score < 1 THEN rrf_score END) OVER {_W} AS best FROM s JOIN fused USING (query_id, doc_id))
      SELECT query_id, doc_id, round(0.9 * score + 0.1 * least(1.0, rrf_score / best), 6) AS blended FROM j""",
    "group_cap_defer": f"""WITH {_SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AS late FROM scored)
      SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM n""",
    "backfill_fill": f"""WITH {_SCORED}, u AS (SELECT query_id, doc_id, score, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS filled FROM scored)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY filled, score DESC, doc_id) AS place FROM u QUALIFY place <= 10""",
    "arm_search": f"WITH {_ARMS} SELECT query_id, arm, doc_id, score, rank FROM arm_top",
    "scored_pool": f"""WITH {_ARMS}, best AS ({_top('scores', 3)}), pool AS (SELECT DISTINCT query_id, doc_id FROM arm_top),
      q AS (SELECT query_id, list_distinct(w) AS w FROM halves), d AS (SELECT doc_id, w0 AS w FROM words)
      SELECT pool.query_id, pool.doc_id, round(coalesce(best.score, len(list_intersect(q.w, d.w)) / len(q.w)), 6) AS score, best.score IS NULL AS fresh
      FROM pool JOIN q USING (query_id) JOIN d USING (doc_id) LEFT JOIN best ON best.query_id = pool.query_id AND best.doc_id = pool.doc_id""",
    "interleave_arms": f"""WITH {_INDEX}, a AS ({_top('scores', 10)}), b AS ({_top('scores', 10, '''score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')''')}),
      u AS (SELECT query_id, doc_id, rank, 0 AS arm FROM a UNION ALL SELECT query_id, doc_id, rank, 1 FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, arm) AS n FROM u QUALIFY n = 1)
      SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, arm) AS place FROM o""",
}
