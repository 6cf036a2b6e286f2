"""Incremental indexing as a stream: new files of a folder, chunked and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.chunking import Chunking, chunk_documents
from ..plans.engine import Engine
from ..sources.convert import convert_files


def file_stream(spark: SparkSession, path: str, corpus: str, extensions: list[str]) -> DataFrame:
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.where(X.extension(F.col("path")).isin(*extensions)).select(
        F.lit(corpus).alias("corpus"), plain.alias("source_path"), X.filename(plain).alias("filename"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("file_hash")
    )


def index_stream(files: DataFrame, target: str, checkpoint: str, how: Chunking = Chunking()) -> StreamingQuery:
    """Write each batch's chunks to ``target``/batch=<id>: a batch that runs again overwrites itself.
    ``current`` reads them with a file's last batch alone."""

    def one(batch: DataFrame, number: int) -> None:
        docs = convert_files(batch).where("error is null")
        chunk_documents(docs, how).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that a stream wrote, of each file those of the last batch that held it."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("corpus", "source_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["corpus", "source_path", "batch"], "left_semi").drop("batch")


def engine_stream(engine: Engine, corpus: str, checkpoint: str) -> StreamingQuery:
    """New files of a corpus's folder into the engine's index, batch by batch: a file replaces what the
    index holds of it, so a batch that runs again changes nothing."""
    home = next(c for c in engine.config.corpora if c.name == corpus)
    files = file_stream(engine.spark, home.path, corpus, home.extensions)

    def one(batch: DataFrame, number: int) -> None:
        engine.upsert(batch, [corpus])

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
