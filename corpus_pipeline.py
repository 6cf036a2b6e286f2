"""From raw documents to packed training sequences: five stages over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common, exact_dedup, jaccard, mixing, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labelled ones.

    Null and empty texts have no toxic passage and score as clean ones; a text of any length counts
    whole; repeated rows stay or go together; labels without a document, and null ones, are ignored.
    Without labels of both classes no document is told apart, and all stay unless every label is 1. An
    empty table gives an empty one; all columns are returned, and none but doc_id and text is read.
    """
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null texts count as empty ones, null ids as smaller
    than any, and of equal rows one stays. An empty table gives an empty one; all columns are
    returned, and none but doc_id and text is read."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 75 % common shingles hold together, the one with the least doc_id.

    An id goes only if none of its rows stays, so rows that share an id stay together; null ids count
    as larger than any. Null texts and texts without a word link with nothing and stay. An empty
    table gives an empty one; all columns are returned, and none but doc_id and text is read.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    marks = jaccard.join(docs, percent=75, words=5).groupBy("doc_id").agg(F.max(stays).alias("stays"))
    drops = common.materialize(marks.where("not stays").select("doc_id"), "near_drops", rows=docs.count())
    return common.without(docs, drops, [(F.col("doc_id"), "doc_id")])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, the sources nearer to equal: 99 % of the largest entropy, no source more than four times.

    A null source is one of its own; rows without a token go with every epoch of their source;
    repeated rows are read equally often. An empty table gives an empty one; all columns are returned.
    """
    return mixing.mixed(docs, entropy_share=0.99, max_repeats=4.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 1024 ids: of every row, repeated ones too; a null or empty text has one id.
    An empty table gives no piece; other columns than doc_id and text are ignored."""
    pieces = packing.pack(docs, window=1024, remembered=150_000)  # executors still hold what earlier stages left
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The fitted scores, sampled permutations and token ids aren't SQL's to say; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written table of the one before; what a stage wrote for itself
    goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, last = common.written(), docs
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        common.release(spark, docs, since=before)
        common.discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
