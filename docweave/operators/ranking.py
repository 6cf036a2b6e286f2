"""Dense and sparse scoring, floors, fusion, merging and de-duplication of hits.

Hits carry ``query_id, corpus, chunk_id, raw_score`` and ``ord``, the tie-break inside a corpus.
Every operator takes any number of queries at once. Scores are compared at ``DIGITS`` digits, so
equal ones tie wherever they are computed; ties go to the corpus's order, then ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text as X

DIGITS = 9
QUERY_BYTES = 1 << 25  # of query vectors that are broadcast at once
MOST_TERMS = 100_000  # of query terms that are broadcast
K1, B = 1.5, 0.75


def exact(score: Column) -> Column:
    return F.round(score, DIGITS)


def top_per_corpus(hits: DataFrame, k: int, score: str = "raw_score") -> DataFrame:
    """The best ``k`` of each query and corpus, with their 0-based ``rank``."""
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc(score), "ord")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _best_of(scores: np.ndarray, corpora: np.ndarray, k: int) -> np.ndarray:
    """Which of (rows, queries) scores may be among the best ``k`` of their corpus: all that reach the k-th."""
    keep = np.ones(scores.shape, bool)
    for c in np.unique(corpora):
        rows = np.flatnonzero(corpora == c)
        if len(rows) > k:
            keep[rows] = scores[rows] >= np.partition(scores[rows], len(rows) - k, axis=0)[len(rows) - k]
    return keep


def _dense_group(vectors: DataFrame, names: list[str], matrix: np.ndarray, k: int | None) -> DataFrame:
    rest = [c for c in vectors.columns if c != "embedding"]
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    schema = StructType([StructField("query_id", StringType()), *(vectors.schema[c] for c in rest), StructField("raw_score", DoubleType())])
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == matrix.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for b in batches:
            x = b.column(len(rest)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            scores = np.round(x @ matrix, DIGITS)
            keep = ~np.isnan(scores)
            if k is not None:
                corpora = b.column(rest.index("corpus")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                keep &= _best_of(np.where(keep, scores, -np.inf), corpora, k)
            for q, name in enumerate(names):
                at = np.flatnonzero(keep[:, q])
                if len(at):
                    own = b.select(list(range(len(rest)))).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *own.columns, pa.array(scores[at, q])], names=["query_id", *rest, "raw_score"])

    return vectors.where(whole).select(*rest, "embedding").mapInArrow(run, schema)


def dense_scores(vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int | None = None) -> DataFrame:
    """Inner product of every vector with each query vector, a matrix product an Arrow batch.

    With ``k`` a batch gives only what may be among the best ``k`` of its query and corpus, so few
    rows leave the scan. Vectors of another length, and null ones, have no score. The queries are
    broadcast; more than ``QUERY_BYTES`` of them take a scan for each such part.
    """
    if not queries:
        return _dense_group(vectors.limit(0), [], np.zeros((0, 0)), k)
    most = max(1, QUERY_BYTES // (8 * max(1, len(queries[0][1]))))
    parts = [queries[at : at + most] for at in range(0, len(queries), most)]
    return reduce(DataFrame.unionByName, (_dense_group(vectors, [q for q, _ in p], np.array([v for _, v in p], float).T, k) for p in parts))


def postings(texts: DataFrame) -> DataFrame:
    """(corpus, chunk_id, ord, term, tf, dl) of (corpus, chunk_id, ord, text)."""
    toks = texts.select("corpus", "chunk_id", "ord", X.tokens(F.col("text")).alias("t"))
    one = toks.select("corpus", "chunk_id", "ord", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return one.groupBy("corpus", "chunk_id", "ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(texts: DataFrame) -> DataFrame:
    return texts.select("corpus", "chunk_id", F.size(X.tokens(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(corpus, term, df) straight from (corpus, text): one aggregate, combined before its shuffle."""
    terms = texts.select("corpus", F.explode(F.array_distinct(X.tokens(F.col("text"), stop=False))).alias("term"))
    return terms.where(~F.col("term").isin(*X.STOP_WORDS)).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, query): repeated words count as often as they stand."""
    return queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(posts: DataFrame, stats: DataFrame, terms: DataFrame, frequencies: DataFrame | None = None, *, n_terms: int = 0, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 (Lucene's form) of every text with a query term; statistics are each corpus's own.

    ``terms`` (query_id, term, qtf) are broadcast if they are known to be ``MOST_TERMS`` at most. df
    is taken from ``frequencies``, or else counted over the matching postings. 
    """
    asked = F.broadcast(terms) if n_terms <= MOST_TERMS else terms
    met = posts.join(asked, "term")
    if frequencies is None:
        frequencies = met.groupBy("corpus", "term", "query_id").agg(F.count(F.lit(1)).alias("df"))
        rows = met.join(frequencies, ["corpus", "term", "query_id"])
    else:
        rows = met.join(frequencies, ["corpus", "term"])
    rows = rows.join(F.broadcast(stats), "corpus")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "corpus", "chunk_id", "ord").agg(exact(F.sum(part)).alias("raw_score")).where("raw_score > 0")


def bm25_search(texts: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of (corpus, chunk_id, ord, text) that has no stored postings.

    The words of the (few, short) queries come to the driver and go into the plan, so a text keeps
    its length and its matching words only. Those narrow rows cross one exchange, which statistics
    and scores share: texts are read and cut into words once.
    """
    terms = query_terms(queries)
    asked = [r.asDict() for r in terms.limit(MOST_TERMS + 1).collect()]
    if not asked or len(asked) > MOST_TERMS:
        return bm25_scores(postings(texts), corpus_stats(doc_stats(texts)), terms, n_terms=len(asked), k1=k1, b=b)
    words = sorted({r["term"] for r in asked})
    t = X.tokens(F.col("text"))
    narrow = texts.select("corpus", "chunk_id", "ord", t.alias("t")).select("corpus", "chunk_id", "ord", F.size("t").cast("long").alias("dl"), F.filter("t", lambda x: x.isin(*words)).alias("m"))
    narrow = narrow.repartition("chunk_id")
    posts = narrow.select("corpus", "chunk_id", "ord", "dl", F.explode("m").alias("term")).groupBy("corpus", "chunk_id", "ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    small = texts.sparkSession.createDataFrame([(r["query_id"], r["term"], r["qtf"]) for r in asked], "query_id string, term string, qtf bigint")
    return bm25_scores(posts, corpus_stats(narrow), small, n_terms=len(asked), k1=k1, b=b)


def effective_floor(corpora: DataFrame, call: float | None = None, default: float | None = None) -> DataFrame:
    """Each corpus's largest distance: its own, else the call's, else the default."""
    return corpora.withColumn("floor", F.coalesce("max_distance", F.lit(call).cast("double"), F.lit(default).cast("double")))


def apply_floor(hits: DataFrame, floors: DataFrame) -> DataFrame:
    """Hits with ``kept``: whether the similarity reaches 1 - floor (always, where there is none)."""
    f = F.broadcast(floors.select("corpus", "floor"))
    near = F.coalesce("raw_score", F.lit(1.0)) >= F.round(1 - F.col("floor"), DIGITS)
    return hits.join(f, "corpus", "left").withColumn("kept", F.coalesce(near, F.lit(True))).drop("floor")


@dataclass(frozen=True)
class Fusion:
    alpha: float = 0.3
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0


def fuse(dense: DataFrame, sparse: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """Score-normalised reciprocal-rank fusion, by query and corpus.

    In each list scores are scaled to 0..1 (all 1, if they hardly differ); a hit's share is
    weight * (alpha * scaled + (1 - alpha) / (rrf_k + rank + 1)). One union and one aggregate do
    what a full outer join would.
    """
    names = ["query_id", "corpus", "chunk_id", "ord", "raw_score", "rank"]
    both = dense.select(*names, F.lit("dense").alias("list")).unionByName(sparse.select(*names, F.lit("sparse").alias("list")))
    w = Window.partitionBy("query_id", "corpus", "list")
    low, high = F.min("raw_score").over(w), F.max("raw_score").over(w)
    scaled = F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col("raw_score") - low) / (high - low))
    weight = F.when(F.col("list") == "dense", F.lit(how.dense_weight)).otherwise(F.lit(how.sparse_weight))
    share = weight * (how.alpha * scaled + (1 - how.alpha) / (how.rrf_k + F.col("rank") + 1))
    shares = both.withColumn("share", share)
    dense_raw = F.max(F.when(F.col("list") == "dense", F.col("raw_score")))
    return shares.groupBy("query_id", "corpus", "chunk_id", "ord").agg(exact(F.sum("share")).alias("score"), dense_raw.alias("dense_score"))


def merge(hits: DataFrame, corpora: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    """The best ``k`` of each query over all corpora, with 1-based ``place``."""
    joined = hits.join(F.broadcast(corpora.select("corpus", "corpus_ord")), "corpus")
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "corpus_ord", "ord")
    placed = joined.withColumn("place", F.row_number().over(w))
    return placed.where(F.col("place") <= k) if k is not None else placed


def weighted(hits: DataFrame, corpora: DataFrame) -> DataFrame:
    return hits.join(F.broadcast(corpora.select("corpus", "weight")), "corpus").withColumn("score", exact(F.col("raw_score") * F.col("weight"))).drop("weight")


def dedup_sections(hits: DataFrame) -> DataFrame:
    """The first hit of each section by ``place``; hits without a real section all stay."""
    free = F.coalesce(F.col("section_id"), F.lit("")).rlike("^$|^unstructured:")
    w = Window.partitionBy("query_id", "section_id", F.when(free, F.col("place"))).orderBy("place")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rerank_by_headings(hits: DataFrame, query: Column, weight: float = 0.3) -> DataFrame:
    """Adds weight times the share of the query's words that stand in the hit's headings."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""))
    h = F.array_distinct(F.flatten(F.transform(F.coalesce("heading_path", F.array().cast("array<string>")), lambda x: F.split(F.lower(x), r"\s+"))))
    boost = F.when((F.size(q) > 0) & (F.size(F.coalesce("heading_path", F.array().cast("array<string>"))) > 0), F.size(F.array_intersect(q, h)) / F.size(q)).otherwise(F.lit(0.0))
    return hits.withColumn("score", exact(F.col("score") + weight * boost))
