"""What an index run has to do: changed, new and deleted files, statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(scanned: DataFrame, known: DataFrame, *, force: bool = False) -> DataFrame:
    """Scanned files that aren't known with the same content."""
    if force:
        return scanned
    return scanned.join(known.select("corpus", "source_path", "file_hash"), ["corpus", "source_path", "file_hash"], "left_anti")


def deleted(scanned: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(scanned.select("corpus", "source_path"), ["corpus", "source_path"], "left_anti")


def live(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files that are there; done before any top-k, so nothing is under-filled."""
    return chunks.join(files.select("corpus", "source_path"), ["corpus", "source_path"], "left_semi")


def stale_ratio(chunks: DataFrame, files: DataFrame) -> DataFrame:
    there = files.select("corpus", "source_path", F.lit(1).alias("there")).distinct()
    rows = chunks.join(there, ["corpus", "source_path"], "left")
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("there").isNull()).alias("stale")).withColumn("ratio", F.col("stale") / F.col("chunks"))


def upsert(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Old rows of files that weren't touched, and the new rows: a changed file's chunks are replaced."""
    keep = old.join(touched.select("corpus", "source_path").distinct(), ["corpus", "source_path"], "left_anti")
    return keep.unionByName(new)


def run_stats(scanned: DataFrame, done: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(corpus, files_indexed, files_skipped, chunks_created, errors) of an index run."""
    key = "corpus"
    s = scanned.groupBy(key).agg(F.count(F.lit(1)).alias("scanned"))
    d = done.groupBy(key).agg(F.count(F.lit(1)).alias("files_indexed"))
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks_created"))
    e = errors.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"), F.sort_array(F.collect_list(F.struct(F.col("source_path").alias("file"), "error"))).alias("errors"))
    out = s.join(d, key, "left").join(c, key, "left").join(e, key, "left")
    z = F.lit(0)
    skipped = F.col("scanned") - F.coalesce("files_indexed", z) - F.coalesce("n_errors", z)
    none = F.array().cast("array<struct<file:string,error:string>>")
    return out.select(key, F.coalesce("files_indexed", z).alias("files_indexed"), skipped.alias("files_skipped"), F.coalesce("chunks_created", z).alias("chunks_created"), F.coalesce("errors", none).alias("errors"))


def list_documents(files: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("corpus", "source_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return files.join(counts, ["corpus", "source_path"], "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def corpus_status(corpora: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    c = chunks.groupBy("corpus").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"))
    f = files.groupBy("corpus").agg(F.countDistinct("source_path").alias("files"))
    out = corpora.join(c, "corpus", "left").join(f, "corpus", "left")
    return out.select("corpus", "weight", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("chunks", "vectors", "files")))


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct wanted keys that a cache table lacks: what to convert or embed."""
    return wanted.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """hits, misses and their share, of (hit boolean) rows."""
    return lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
