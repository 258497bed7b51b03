"""Lexical search: an inverted index by chunks of documents, written once, and BM25 within the chunks.

A scan task turns some thousand documents at a time into a chunk: for each token the
places of its documents and how often they have it, so building shuffles no postings.
Document frequencies are added up over chunks. A batch of queries is joined to the
postings of its tokens only; these go to a task for each chunk and block of queries, which
adds up the scores of its documents as an array and passes on the best k of each query.
So the exchange carries postings of asked tokens, and k rows for each query and chunk,
never a row for each query and document.

An index is a folder; it is opened if it is whole there, else built (``open_index``).
A document without words has its id as its only word, so that counts hold. Rows that
repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wadi.functions import text as T
from wadi.functions.memory import release

K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.65, 0.25
#: Words of a chunk and queries of a block, at most; a document with more words is a chunk of its own.
CHUNK_WORDS, BLOCK = 1 << 20, 256
#: Scores are compared after rounding, so those this near the last one go on too.
MARGIN = 1e-6

_ROWS = "chunk long, token string, places array<int>, tfs array<int>, ids array<long>, lengths array<int>"


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words)."""
    words = T.tokens(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("w")).select("doc_id", F.when(F.size("w") == 0, F.array(F.col("doc_id").cast("string"))).otherwise(F.col("w")).alias("words"))


def _chunk(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    """Postings of a chunk, tokens in order, and first its documents with their lengths."""
    n, words = batch.num_rows, batch.column(1)
    flat, lengths = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank[order] = np.arange(len(order))
    key = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths)
    pairs, tfs = np.unique(key, return_counts=True)
    token, place = np.divmod(pairs, n)
    first = np.searchsorted(token, np.arange(len(order) + 1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], first]).astype(np.int32)), pa.array(values.astype(np.int32)))
    m = len(order)
    only = pa.array([True] + [False] * m)
    own = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(m + 1, n)]).astype(np.int32)), pa.array(values, kind), mask=pa.array([False] + [True] * m))
    tokens = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(order)).cast(pa.string())])
    places, counts = lists(place), lists(tfs)
    null = pa.scalar(None, places.type)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m + 1, chunk)), tokens, pc.if_else(only, null, places), pc.if_else(only, null, counts), own(batch.column(0).to_pylist(), pa.int64()), own(lengths, pa.int32())], names=["chunk", "token", "places", "tfs", "ids", "lengths"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + CHUNK_WORDS, "right")))
            yield _chunk(batch.slice(start, end - start), number)
            number, start = number + 1, end
    batch = None
    release()


class Index:
    """Postings (chunk, token, places, tfs), chunks (chunk, ids, lengths) and terms (token, df, idf)."""

    def __init__(self, rows: DataFrame, terms: DataFrame):
        self.postings = rows.where("token IS NOT NULL").select("chunk", "token", "places", "tfs")
        self.chunks = rows.where("token IS NULL").select("chunk", "ids", "lengths")
        self.terms = terms
        total = self.chunks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
        self.n = total["n"] or 0
        self.mean_length = total["words"] / self.n if self.n else 0.0


def _terms(rows: DataFrame, n: int) -> DataFrame:
    df = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum(F.size("places")).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, NEGATIVE_IDF_SHARE * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row: the mean


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of ``docs`` and opens it."""
    spark = docs.sparkSession
    tokenized(docs, id_col, text_col).mapInArrow(_chunks, _ROWS).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/rows")
    n = rows.where("token IS NULL").agg(F.sum(F.size("ids"))).first()[0] or 0
    _terms(rows, n).write.mode("overwrite").parquet(f"{folder}/terms")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.schema(_ROWS).parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/terms"))


def open_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index in the folder; built first if it is not whole there. The terms are written last."""
    spark = docs.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/terms/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return load(spark, folder)
    return build(docs, folder, id_col, text_col)


def query_tokens(queries: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, token, times) from (query_id, text)."""
    words = T.tokens(F.col("text"))
    words = F.slice(words, 1, first) if first else words
    return queries.select("query_id", F.explode(words).alias("token")).groupBy("query_id", "token").agg(F.count("*").cast("double").alias("times"))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best positive scores, and of those that rounding might put among them."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - MARGIN]
    return found


def _scored(batches: Iterator[pa.RecordBatch], k: int, mean_length: float, plain: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the best documents of each chunk and block.

    From rows (chunk, block, kind, places, tfs, ids, lengths, asked), all of a chunk and block in a row:
    first its documents (0), then those in scope (1), then postings (2).
    """
    at, ids, norm, scope, scores, queries = None, None, None, None, {}, None

    def rows() -> Iterator[pa.RecordBatch]:
        for query, own in scores.items():
            if scope is not None:
                own = np.where(scope, own, 0.0)
            best = _best(own, k)
            if len(best):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(best), queries), pa.array(ids[best]), pa.array(own[best])], names=["query_id", "doc_id", "score"])

    for batch in batches:
        chunk, block, kind = (batch.column(i).to_numpy() for i in range(3))
        places, tfs, own_ids, lengths, asked = (batch.column(i) for i in range(3, 8))
        queries = batch.schema.field(7).type.value_type.field(0).type
        for i in range(batch.num_rows):
            if (chunk[i], block[i]) != at:
                yield from rows()
                at, scope, scores = (chunk[i], block[i]), None, {}
            if kind[i] == 0:
                ids, size = own_ids[i].values.to_numpy(), lengths[i].values.to_numpy()
                norm = K1 * (1 - B + B * size / mean_length)
            elif kind[i] == 1:
                scope = np.zeros(len(ids), bool)
                scope[places[i].values.to_numpy()] = True
            else:
                where, tf = places[i].values.to_numpy(), tfs[i].values.to_numpy()
                part = np.ones(len(tf)) if plain else tf * (K1 + 1) / (tf + norm[where])
                for want in asked[i].as_py():
                    own = scores.get(want["query_id"])
                    if own is None:
                        own = scores[want["query_id"]] = np.zeros(len(ids))
                    own[where] += want["weight"] * part
    yield from rows()
    batch = places = tfs = own_ids = lengths = asked = ids = norm = scope = None
    scores = {}
    release()


def _search(index: Index, weights: DataFrame, k: int, scope: DataFrame | None, plain: bool) -> DataFrame:
    spark = weights.sparkSession
    kind = weights.schema["query_id"].dataType.simpleString()
    blocks = -(-weights.select("query_id").distinct().count() // BLOCK) or 1
    asked = weights.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), "token").agg(F.collect_list(F.struct("query_id", "weight")).alias("asked"))
    lists, nothing = "array<int>", F.lit(None)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    no_asked = nothing.cast(f"array<struct<query_id:{kind},weight:double>>").alias("asked")
    heads = index.chunks.select("chunk", every, F.lit(0).alias("kind"), nothing.cast("string").alias("token"), nothing.cast(lists).alias("places"), nothing.cast(lists).alias("tfs"), "ids", "lengths", no_asked)
    postings = index.postings.join(asked, "token").select("chunk", "block", F.lit(2).alias("kind"), "token", "places", "tfs", nothing.cast("array<long>").alias("ids"), nothing.cast(lists).alias("lengths"), "asked")
    both = heads.unionByName(postings)
    if scope is not None:
        own = index.chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
        own = index.chunks.select("chunk").join(own.groupBy("chunk").agg(F.collect_list("place").alias("places")), "chunk", "left")
        both = both.unionByName(own.select("chunk", every, F.lit(1).alias("kind"), nothing.cast("string").alias("token"), F.coalesce("places", F.array().cast(lists)).alias("places"), nothing.cast(lists).alias("tfs"), nothing.cast("array<long>").alias("ids"), nothing.cast(lists).alias("lengths"), no_asked))
    dealt = both.repartition("chunk", "block").sortWithinPartitions("chunk", "block", "kind", "token")
    mean_length = index.mean_length
    found = dealt.select("chunk", "block", "kind", "places", "tfs", "ids", "lengths", "asked").mapInArrow(lambda it: _scored(it, k, mean_length, plain), f"query_id {kind}, doc_id long, score double")
    return top(found.withColumn("score", F.round("score", 6)).where("score > 0"), k)


def search(index: Index, tokens: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k by query; a scope (doc_id) limits the documents before the cut, never after it."""
    weights = tokens.join(index.terms, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
    return _search(index, weights, k, scope, False)


def search_overlap(index: Index, tokens: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """The same by the number of the query's tokens that a document has."""
    return _search(index, tokens.select("query_id", "token", F.lit(1.0).alias("weight")).distinct(), k, scope, True)


def top(found: DataFrame, k: int, by: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Best k rows of each query, ranked by score, then id."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def tf_part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """The weight of a term in a document, for other plans."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
