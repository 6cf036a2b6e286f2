"""Directory scans and text readers over any file system that Spark reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Corpus
from ..functions import text as X
from .paths import Folder

SCANNED = "corpus string, source_path string, filename string, file_size bigint, modified_at timestamp, content binary, file_hash string"


def suffix_glob(extensions: list[str]) -> str:
    """A file name pattern for these suffixes in either case."""
    one = ["*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.sub(r"([\[\]{}*?,\\])", r"\\\1", c) for c in e) for e in extensions]
    return one[0] if len(one) == 1 else "{" + ",".join(one) + "}"


def scan(spark: SparkSession, corpus: Corpus, *, max_file_size: int = 52_428_800, exclude_dirs: list[str] | None = None) -> DataFrame:
    """(corpus, source_path, filename, file_size, modified_at, content, file_hash) of a corpus's files.

    By lower-cased suffix (which the listing prunes by) and size, outside excluded directories below
    the root; an empty or missing root has no rows. A plan that needs neither content nor hash reads none.
    """
    root = corpus.path.rstrip("/")
    if not corpus.extensions or not Folder(spark, root).exists():
        return spark.createDataFrame([], SCANNED)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix_glob(corpus.extensions)).load(root)
    plain = F.regexp_replace("path", "^file:/*", "/")
    files = files.where((F.col("length") <= max_file_size) & X.extension(F.col("path")).isin(*corpus.extensions))
    below = F.substring(plain, len(re.sub("^file:/*", "/", root)) + 1, 1 << 30)
    for d in exclude_dirs or []:
        files = files.where(~F.contains(below, F.lit(f"/{d}/")))
    return files.select(
        F.lit(corpus.name).alias("corpus"),
        plain.alias("source_path"),
        X.filename(plain).alias("filename"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
        "content",
        F.sha2("content", 256).alias("file_hash"),
    )


def scan_all(spark: SparkSession, config: Config, corpora: list[Corpus] | None = None) -> DataFrame:
    chosen = corpora if corpora is not None else config.corpora
    made = [scan(spark, c, max_file_size=config.indexing.max_file_size, exclude_dirs=config.indexing.exclude_dirs) for c in chosen]
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], SCANNED)
