"""Shared plumbing of the training-data operators: scratch tables, folds, hashing, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5

_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, notebooks), where the session has none, a folder of our own is set;
    on a cluster a missing one is an error, for a machine's own folder would lose tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


ROWS_PER_FILE = 250_000


def materialize(df: DataFrame, tag: str, *, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the planner the true
    size of the table, so that a later join broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``. ``rows`` bounds the rows that the writing stage works
    on: a small table is then written as one file for each ``ROWS_PER_FILE`` of them, not as one for
    each shuffle partition, since tiny files cost more than what is in them. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}/{tag}"
    files = None if rows is None else rows // ROWS_PER_FILE + 1
    if files is not None and files < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.options(**options).parquet(path)
    _SCRATCH.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p).getParent()
        n += bool(path.getFileSystem(conf).delete(path, True))
        _SCRATCH.remove(p)
    return n


def discard(*tables: DataFrame) -> None:
    """Delete these tables of ``materialize``: what was made of them has been written."""
    for t in tables:
        if (path := getattr(t, "_scratch", None)) in _SCRATCH:
            _delete(t.sparkSession, [path])


def written() -> frozenset[str]:
    """The scratch tables there are, for ``release``."""
    return frozenset(_SCRATCH)


def release(spark: SparkSession, *keep: DataFrame, since: frozenset[str] = frozenset()) -> int:
    """Delete the scratch tables written so far (``since`` an earlier state, if one is given) but
    ``keep``; call it when no other result is read any more."""
    stay = since | {getattr(t, "_scratch", None) for t in keep}
    return _delete(spark, [p for p in _SCRATCH if p not in stay])


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; fold 0 is held out from every fit."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows of ``df`` (all, if fewer), chosen by a hash of ``key``.

    Used only to bound what a model is fitted on.
    """
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * limit / n))


def stratified(df: DataFrame, key: Column, stratum: str, limit: int) -> DataFrame:
    """As ``sampled``, but every value of ``stratum`` is in it: a rare one gets a floor of the rows.

    A twentieth of ``limit`` is dealt out evenly as floors (all rows of a value with fewer); values
    above theirs share the rest by one rate. A value's row of least hash is always drawn.
    """
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))
    sizes = {r[0]: (r.n, r.least) for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("least")).collect()}
    if sum(n for n, _ in sizes.values()) <= limit:
        return df
    floor = limit // (20 * len(sizes))
    rare: set = set()
    while True:
        left = limit - sum(min(sizes[v][0], floor) for v in rare)
        n = sum(sizes[v][0] for v in sizes.keys() - rare)
        more = {v for v in sizes.keys() - rare if sizes[v][0] * left / n < min(sizes[v][0], floor)}
        if not more:
            break
        rare |= more
    cuts = {v: max(int((1 << 30) * min(m, floor) / m if v in rare else (1 << 30) * left / n), least + 1) for v, (m, least) in sizes.items()}
    pairs = [F.lit(x) for v in sorted(cuts) for x in (v, cuts[v])]
    return df.where(h < F.element_at(F.create_map(*pairs), F.col(stratum)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled documents of both labels outside the held-out fold.

    The label side is bounded by ``limit`` (two numbers a row), so it is broadcast. Labels other
    than 0 and 1 and null ids are ignored; of repeated labels of one id the largest counts.
    """
    y = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
    y = y.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    y = stratified(y.groupBy("doc_id").agg(F.max("y").alias("y")), F.col("doc_id"), "y", limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")


def trim() -> None:
    """Give freed memory back to the system: workers live on, and beside a JVM every page counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, where the session has the default of 64 MB: a batch stands in the JVM, in
    the worker and, in parts, in Python at once. A bound that the session sets itself is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == "67108864b":
        spark.conf.set(key, "4194304b")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``mapInArrow`` in small batches that trims its worker's memory when a task ends."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def trimmed(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of groups that trims its worker's memory after large ones."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        if table.nbytes > 1 << 22:
            trim()
        return out

    return run


def rows(batches: Iterator[pa.RecordBatch], *names: str, size: int = 256) -> Iterator[tuple[list[Any], ...]]:
    """Column lists of at most ``size`` rows, so that very long texts don't pile up in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def batch(schema: pa.Schema, columns: list[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection of 64-bit words), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression, by Newton's method with halving."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6] * len(x)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * keep @ (v * v))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        scale = 1.0
        while scale > 1e-4 and (new := loss(w - scale * step)) > now:
            scale /= 2
        if scale <= 1e-4:
            break
        w, gain, now = w - scale * step, now - new, new
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


BITMAP_MOST = 28


def bitmap(df: DataFrame, key: Column, n: int) -> tuple[int, np.ndarray]:
    """(bits, packed bits) of the hashed keys of ``df``: a filter with false positives only.

    16 places a key, up to 2 ** BITMAP_MOST (32 MB, checked, as it is broadcast): that is 16 million
    keys at a false share of 6 %, 60 million at 22 %, and so on. With ever more keys it spares less
    of the join behind it, which is right by itself. Keys cross the shuffle once, by the 32,768-bit
    part of the filter that they fall in.
    """
    bits = min(BITMAP_MOST, max(15, (16 * n).bit_length()))
    place = df.select((bitmap_place(key, bits) + 1).alias("place"))
    parts = place.select(F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("bit"))
    parts = parts.repartition(max(1, min(1 << (bits - 15), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "part")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("m")).collect():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.m, np.uint8)
    return bits, out


def bitmap_place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def set_in(places: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set in a packed bitmap."""
    return (places[found >> 3] >> (found & 7).astype(np.uint8) & 1).astype(bool)


def by_bitmap(df: DataFrame, key: Column, bits: int, places: np.ndarray, keep: bool) -> DataFrame:
    """The rows of ``df``, all columns, whose key's place in a bitmap is set (or, keep=False, isn't)."""
    mask = df.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            found = set_in(mask.value, b.column(last).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(found == keep)).select(list(range(last)))

    marked = df.select("*", bitmap_place(key, bits).alias(f"place_{uuid.uuid4().hex}"))
    return arrow_map(marked, run, df.schema)


def without(df: DataFrame, drops: DataFrame, keys: list[tuple[Column, str]]) -> DataFrame:
    """The rows of ``df`` that no row of the written table ``drops`` matches (nulls equal nulls).

    Rows outside a bounded bitmap of the dropped keys stay at once; only the others are joined, so
    texts that stay don't cross a shuffle, however many rows go.
    """
    hashed = F.xxhash64(*(c for c, _ in keys))
    bits, places = bitmap(drops, F.xxhash64(*(F.col(n) for _, n in keys)), drops.count())
    some = by_bitmap(df, hashed, bits, places, True)
    named = {n: f"{n}_{uuid.uuid4().hex}" for _, n in keys}
    gone = drops.select(*(F.col(n).alias(m) for n, m in named.items()))
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(gone[named[n]]) for c, n in keys))
    return by_bitmap(df, hashed, bits, places, False).unionByName(some.join(gone, same, "left_anti"))


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of ``rows`` to one row a ``key``, with hot keys kept out of the shuffle.

    Keys that hold a thousandth of ``n_rows`` rows or more are a thousand at most: they are
    broadcast. ``groups`` should be a written table, for it is read twice.
    """
    is_hot = F.col(size) * 1000 >= n_rows
    hot = F.broadcast(groups.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(groups.where(~is_hot), key, "left"))
