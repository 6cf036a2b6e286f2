"""Spark session with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, for clusters and folders where it isn't installed."""
    name = spark.sparkContext.applicationId
    if name in _SHIPPED:
        return
    _SHIPPED.add(name)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docweave-"), "docweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("docweave", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)


def session(master: str | None = None, *, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; ``master`` and sizes only where given, so a cluster's own settings stand."""
    b = SparkSession.builder.appName("docweave")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    spark = b.config(map=base | conf).getOrCreate()
    ship(spark)
    return spark
