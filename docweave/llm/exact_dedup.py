"""Exact dedup (operator 4): mergeable counting quotient filters, then byte verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints, lossless.

    A fingerprint is split into a quotient (its ``q`` high bits) and a remainder. Runs of
    remainders stand in order of their quotients, each sorted: ``occupied`` has a bit for every
    quotient of the slice that owns a run, ``run_end`` a bit for each slot that ends one, and
    ``counts`` a count for each slot. Two filters with the same ``q`` and ``low`` merge run by run.
    """

    __slots__ = ("counts", "fingerprints", "low", "q")

    def __init__(self, q: int, low: int, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: sorted, distinct, all with quotients of the slice that begins at ``low``."""
        self.q, self.low, self.fingerprints, self.counts = q, low, fingerprints, counts

    @classmethod
    def build(cls, q: int, low: int, values: np.ndarray) -> CountingQuotientFilter:
        fingerprints, counts = np.unique(values, return_counts=True)
        return cls(q, low, fingerprints, counts.astype(np.uint64))

    def dump(self, width: int) -> bytes:
        """Slots as bit arrays and remainders; ``width`` quotients from ``low`` on. What all filters of a
        slice have in common (q, low, width) isn't written, so a filter of one slot is 15 bytes."""
        shift = np.uint64(64 - self.q)
        quotients = (self.fingerprints >> shift).astype(np.int64) - self.low
        occupied = np.zeros(width, np.uint8)
        occupied[quotients] = 1
        run_end = np.ones(len(quotients), np.uint8)
        run_end[:-1] = quotients[1:] != quotients[:-1]
        remainders = self.fingerprints & np.uint64((1 << (64 - self.q)) - 1)
        small = self.counts < 255
        return b"".join(
            (
                np.array([len(quotients)], "<u4").tobytes(),
                np.packbits(occupied).tobytes(),
                np.packbits(run_end).tobytes(),
                remainders.astype("<u8").tobytes(),
                np.where(small, self.counts, 255).astype("u1").tobytes(),
                self.counts[~small].astype("<u8").tobytes(),
            )
        )

    @classmethod
    def load(cls, raw: bytes, q: int, low: int, width: int) -> CountingQuotientFilter:
        n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
        occupied = np.unpackbits(np.frombuffer(raw, "u1", -(-width // 8), at))[:width]
        at += -(-width // 8)
        run_end = np.unpackbits(np.frombuffer(raw, "u1", -(-n // 8), at))[:n]
        at += -(-n // 8)
        remainders = np.frombuffer(raw, "<u8", n, at)
        counts = np.frombuffer(raw, "u1", n, at + 8 * n).astype(np.uint64)
        counts[counts == 255] = np.frombuffer(raw, "<u8", -1, at + 9 * n)
        run = np.cumsum(run_end) - run_end
        quotients = np.flatnonzero(occupied)[run] + low
        return cls(q, low, quotients.astype(np.uint64) << np.uint64(64 - q) | remainders, counts)

    def plus(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both runs of sorted slots merged into one; equal slots' counts added."""
        at = np.searchsorted(self.fingerprints, other.fingerprints)
        there = np.zeros(len(at), bool)
        inside = at < len(self.fingerprints)
        there[inside] = self.fingerprints[at[inside]] == other.fingerprints[inside]
        counts = self.counts.copy()
        counts[at[there]] += other.counts[there]
        new = ~there
        fingerprints = np.insert(self.fingerprints, at[new], other.fingerprints[new])
        return CountingQuotientFilter(self.q, self.low, fingerprints, np.insert(counts, at[new], other.counts[new]))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Two by two, so a slot is moved once for each doubling."""
        if any((f.q, f.low) != (filters[0].q, filters[0].low) for f in filters):
            raise ValueError("filters of different slices don't merge")
        while len(filters) > 1:
            filters = [a.plus(b) if b else a for a, b in zip_longest(filters[::2], filters[1::2])]
        return filters[0]


def repeated_fingerprints(prints: DataFrame, n_rows: int, *, slice_rows: int = 2_000_000, chunk: int = 4_000_000) -> DataFrame:
    """(fp, n): fingerprints that occur more than once, from filters built by each partition.

    A partition has one filter (one for each ``chunk`` rows, if it is larger, which bounds its
    memory), cut into slices of the quotient range; slices of a range meet in one task and merge.
    There are about four slices for each shuffle partition, more if they held over ``slice_rows``
    entries. A slice has as many quotients as a filter has rows in it, so a filter of few rows is small.
    """
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_bits = max(4 * partitions - 1, n_rows // slice_rows, 1).bit_length()
    q = slice_bits + min(10, max(3, (n_rows // (partitions << slice_bits)).bit_length()))
    width = 1 << (q - slice_bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int64()), ("filter", pa.binary())])
        held: list[np.ndarray] = []

        def dump() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            held.clear()
            slices = (values >> np.uint64(64 - slice_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
            ends = np.r_[cuts[1:], len(values)]
            for at in range(0, len(cuts), 10_000):
                made = [(int(slices[a]), CountingQuotientFilter(q, int(slices[a]) * width, values[a:b], counts[a:b].astype(np.uint64)).dump(width)) for a, b in zip(cuts[at : at + 10_000], ends[at : at + 10_000], strict=True)]
                yield common.batch(schema, [list(c) for c in zip(*made, strict=True)])

        size = 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size >= chunk:
                yield from dump()
                size = 0
        if size:
            yield from dump()

    def merge(table: pa.Table) -> pa.Table:
        low = table.column("slice")[0].as_py() * width
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.load(raw, q, low, width) for raw in table.column("filter").to_pylist()])
        more = merged.counts > 1
        return pa.table({"fp": merged.fingerprints[more].view(np.int64), "n": merged.counts[more].astype(np.int64)})

    return common.arrow_map(prints, build, "slice bigint, filter binary").groupBy("slice").applyInArrow(common.trimmed(merge), "fp bigint, n bigint")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, keep_id, group_size, kept.

    Texts are equal when their bytes are; null counts as empty. The row with the largest doc_id of
    a group stays (a null id counts as smaller than any). Rows with the same text and the same id
    can't be told apart; exactly one of them stays. Empty tables give no row; other columns play no
    part, whatever their names.

    Rows whose fingerprint occurs once are single. The others, with their texts, are grouped by the
    text itself, so equal fingerprints of different texts do no harm; the group's size, largest id
    and digest are pre-aggregated before the shuffle, so a group of any size crosses it as a row a
    task. A bounded bitmap of the repeated fingerprints keeps most other texts out of that shuffle.
    Groups of a thousandth of all rows or more are a thousand at most; they reach their rows by a
    broadcast, so no hot digest is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = common.materialize(docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256")), "digests")
    n_rows = digests.count()
    repeated = common.materialize(repeated_fingerprints(digests.select("fp"), n_rows), "repeated", rows=n_rows)
    n_repeated = repeated.count()
    bits, places = common.bitmap(repeated, F.col("fp"), n_repeated)
    likely = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))
    routed = common.by_bitmap(likely, F.col("fp"), bits, places, True).join(repeated.select("fp"), "fp", "left_semi")
    groups = common.materialize(
        routed.groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "groups",
        rows=200 * n_repeated,  # texts, and some for each task
    )
    common.discard(repeated)
    rows = common.join_hot(digests.select("doc_id", "text_sha256"), groups, "text_sha256", "group_size", n_rows)
    single = F.col("group_size").isNull()
    stays = single | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = rows.select(
        "doc_id",
        "text_sha256",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
    )
    twins = common.materialize(
        rows.where("kept and group_size > 1").groupBy("doc_id", "text_sha256", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twins", rows=4 * n_repeated
    )
    if common.is_empty(twins):
        return rows
    t = twins.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    same = rows["doc_id"].eqNullSafe(t["id"]) & (rows["text_sha256"] == t["sha"])
    copies = twins.select("doc_id", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return rows.join(t, same, "left_anti").unionByName(copies.select("doc_id", "text_sha256", "keep_id", "group_size", (F.col("i") == 1).alias("kept")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``exact_groups`` drops."""
    marks = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kept")).alias("stay"))
    marks = common.materialize(marks.where("n > stay"), "marks")
    drops = marks.where("stay = 0").select("doc_id", "text_sha256")
    twins = marks.where("stay > 0").select("doc_id", "text_sha256")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keys = [(F.col("doc_id"), "doc_id"), (digest, "text_sha256")]
    left = common.without(docs, drops, keys)
    if common.is_empty(twins):
        return left
    same = docs["doc_id"].eqNullSafe(twins["doc_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == twins["text_sha256"])
    return common.without(left, twins, keys).unionByName(docs.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"]))
