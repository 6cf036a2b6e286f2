"""Exact top-k search (operator 7): sorted lists read in step, with bounds and no random access."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dims, comps): floor(scale * x) of each component; vectors that are null, empty or hold
    a null or a number that isn't finite are left out."""
    e = F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(e.isNotNull() & (F.size(e) > 0) & whole & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("comps"))


@dataclass
class NoRandomAccess:
    """Top k of inner products for a group of queries, one block of candidates after another.

    For each dimension of a block there is a list sorted by the component; a query reads it from the
    top where its own component is positive and from the bottom where that is negative. All lists are
    walked in steps. What is still unread of a list is at most the last entry read, times the
    query's component, so ``outside``, the sum over all lists, bounds every candidate not seen yet.
    Once it is below the k-th best score so far (of complete candidates, in this block and those
    before), no outsider can qualify, and the upper bounds of those seen are looked at: the sum of
    what was read of a candidate and the bounds of what wasn't. When at most ``few`` of a query are
    left, each has its own sum, which grows by the entries read from there on, until it is complete
    or its bound falls below the k-th best. No candidate is ever looked up: every sum is of entries
    that the walk came upon. Equal scores go to the smaller id, so what can only tie stays.

    ``decided`` and ``resolved`` count the entries of its lists that each query had read when no
    outsider could qualify any more, and when all its scores were complete; ``listed`` counts all.
    """

    keys: np.ndarray  # of the queries
    ids: np.ndarray
    queries: np.ndarray
    k: int
    few: int = 64
    steps: int = 16
    best: np.ndarray = field(init=False)  # (queries, k) scores
    names: np.ndarray = field(init=False)  # their ids
    decided: int = 0
    resolved: int = 0
    listed: int = 0

    def __post_init__(self) -> None:
        whole = np.issubdtype(self.queries.dtype, np.integer)
        self.none = np.iinfo(self.queries.dtype).min + 1 if whole else -np.inf  # its negative is a number too
        self.best = np.full((len(self.ids), self.k), self.none, self.queries.dtype)
        self.names = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.up, self.down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        self.lists = (self.queries != 0).sum(axis=1)

    def _own(self, ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """(row, query) where a candidate is the query's own row: the first with its id and its vector."""
        order = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        found = []
        for q in np.flatnonzero(high > low).tolist():
            same = [r for r in order[low[q] : high[q]].tolist() if (x[r] == self.queries[q]).all()]
            found += [(same[0], q)] if same else []
        return found

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, d = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        lists = np.take_along_axis(x, order, axis=0)
        column = np.arange(d)
        high, low = np.zeros_like(x), np.zeros_like(x)  # what was read of each candidate, from the top and from the bottom
        unread_high, unread_low = np.ones_like(x), np.ones_like(x)
        barred = np.zeros((n, len(self.ids)), bool)
        for r, q in self._own(ids, x):
            barred[r, q] = True
        todo, undecided = np.arange(len(self.ids)), np.ones(len(self.ids), bool)
        c, q = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the few candidates left, with their queries and sums
        total = np.zeros(0, x.dtype)
        self.listed += int(n * self.lists.sum())
        depth = 0
        while len(todo) or len(c):
            new = min(n, depth + max(1, n // self.steps))
            rows = order[n - new : n - depth]
            high[rows, column], unread_high[rows, column] = lists[n - new : n - depth], 0
            if len(c):
                fresh = np.zeros_like(x)
                fresh[rows, column] = lists[n - new : n - depth]
                total += np.einsum("ij,ij->i", fresh[c], self.up[q])
            rows = order[depth:new]
            low[rows, column], unread_low[rows, column] = lists[depth:new], 0
            if len(c):
                fresh = np.zeros_like(x)
                fresh[rows, column] = lists[depth:new]
                total += np.einsum("ij,ij->i", fresh[c], self.down[q])
            depth, last_high, last_low = new, lists[n - new], lists[new - 1]
            if len(c):
                c, q, total = self._settle(ids, c, q, total, unread_high, unread_low, last_high, last_low, depth)
            outside = self.up[todo] @ last_high + self.down[todo] @ last_low
            out = (outside < self.best[todo, -1]) if depth < n else np.ones(len(todo), bool)
            fresh_out = todo[out & undecided[todo]]
            self.decided += int(depth * self.lists[fresh_out].sum())
            undecided[fresh_out] = False
            some = todo[out]
            if len(some):
                up, down = self.up[some].T, self.down[some].T
                sums = high @ up + low @ down
                upper = sums + unread_high @ (up * last_high[:, None]) + unread_low @ (down * last_low[:, None]) if depth < n else sums
                alive = (upper >= self.best[some, -1]) & ~barred[:, some]
                ready = (alive.sum(axis=0) <= self.few) | (depth == n)
                row, at = np.nonzero(alive[:, ready])
                c, q, total = np.r_[c, row], np.r_[q, some[ready][at]], np.r_[total, sums[:, ready][row, at]]
                left = some[ready]
                todo = np.setdiff1d(todo, left, assume_unique=True)
                lone = np.setdiff1d(left, q)
                self.resolved += int(depth * self.lists[lone].sum())
                if depth == n:
                    c, q, total = self._settle(ids, c, q, total, unread_high, unread_low, last_high, last_low, depth)

    def _settle(self, ids: np.ndarray, c: np.ndarray, q: np.ndarray, total: np.ndarray, unread_high: np.ndarray, unread_low: np.ndarray, last_high: np.ndarray, last_low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take complete sums into the best and let go of what can't qualify; the others."""
        before = np.unique(q)
        missing = np.einsum("ij,ij->i", unread_high[c], (self.up[q] != 0).astype(total.dtype)) + np.einsum("ij,ij->i", unread_low[c], (self.down[q] != 0).astype(total.dtype))
        done = missing == 0
        self._take(ids, c[done], q[done], total[done])
        c, q, total = c[~done], q[~done], total[~done]
        upper = total + np.einsum("ij,ij->i", unread_high[c] * last_high, self.up[q]) + np.einsum("ij,ij->i", unread_low[c] * last_low, self.down[q])
        stay = upper >= self.best[q, -1]
        c, q, total = c[stay], q[stay], total[stay]
        self.resolved += int(depth * self.lists[np.setdiff1d(before, q, assume_unique=False)].sum())
        return c, q, total

    def _take(self, ids: np.ndarray, c: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        todo = np.unique(q)
        if not len(todo):
            return
        rows = np.r_[q, np.repeat(todo, self.k)]
        score = np.r_[score, self.best[todo].ravel()]
        name = np.r_[ids[c], self.names[todo].ravel()]
        order = np.lexsort((name, -score, rows))
        rows, score, name = rows[order], score[order], name[order]
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        take = begin[:, None] + np.arange(self.k)
        self.best[todo], self.names[todo] = score[take], name[take]


_BLOCK = "dims int, block bigint, keys binary, ids binary, comps binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(key, vec_id, dims, comps) of one length packed ``size`` to a row, as 64-bit integers."""
    schema = pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("comps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def pack(dims: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return common.batch(schema, [[dims], [made], *([np.concatenate(x).astype("<i8").tobytes()] for x in held.pop(dims))])

        for b in batches:
            keys, ids, dims = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            flat, ends = b.column(3).flatten().to_numpy(), np.cumsum(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                comps = flat[(ends[at] - d)[:, None] + np.arange(d)]
                for lo in range(0, len(at), size):
                    one = held.setdefault(d, [[], [], []])
                    for x, y in zip(one, (keys[at], ids[at], comps), strict=True):
                        x.append(y[lo : lo + size].ravel())
                    if sum(map(len, one[0])) >= size:
                        yield pack(d)
        for d in list(held):
            yield pack(d)

    return common.arrow_map(rows.select("key", "vec_id", "dims", "comps"), run, _BLOCK)


def _exact(d: int, most: int, asked: int) -> type:
    """The number type in which inner products of d components are exact."""
    if d * most * asked < 2**53:
        return np.float64
    if d * most * asked < 2**62:
        return np.int64
    raise ValueError("inner products of these components pass 64 bits")


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())), 1)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, block_rows: int = 2048, lane_rows: int = 65_536, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``queries`` are rows of the same form. Only vectors of a query's own length are its candidates,
    never its own row: of rows with its id and its vector one is left out, and other vectors of its
    id are candidates. Ties go to the smaller id; fewer candidates give fewer rows; repeated rows
    count as often as they occur, and each row of ``queries`` has its ranking, also where ids repeat;
    empty tables give no row; other columns play no part. Products are exact integers; components
    so large that they pass 64 bits raise ValueError. Vectors of any length are read whole.

    Candidates are packed into blocks, blocks dealt into lanes and queries into groups; each lane
    meets each group once, in one task that holds a group and a lane of fixed sizes. Every task
    returns at most k rows a query.
    """
    rows, asked = quantised(vectors, scale), quantised(queries, scale)
    n, m = rows.count(), asked.count()

    def repeated(df: DataFrame) -> bool:
        return not common.is_empty(df.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    # a candidate's key is how often it occurs (k + 1 is enough), a query's the row that it is
    rows = rows.groupBy("vec_id", "dims", "comps").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("key")) if repeated(rows) else rows.withColumn("key", F.lit(1).cast("long"))
    named = None
    if repeated(asked):
        asked = named = common.materialize(asked.withColumn("key", F.monotonically_increasing_id()), "asked")
    else:
        asked = asked.withColumn("key", F.col("vec_id"))
    parallel = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, -(-n // lane_rows), min(parallel, n // block_rows))
    groups = max(1, -(-m // query_rows))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    group = F.pmod(F.xxhash64("block", F.lit("q")), F.lit(groups)).cast("int")
    size = max(1, min(block_rows, -(-n // (2 * lanes))))
    candidates = _blocks(rows, size).withColumn("lane", lane).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    questions = _blocks(asked, min(query_rows, 1024)).withColumn("part", group).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def unpack(table: pa.Table, d: int) -> list[np.ndarray]:
        own = [r for r in table.to_pylist() if r["dims"] == d]
        return [np.concatenate([np.frombuffer(r[c], "<i8") for r in own] or [np.zeros(0, "<i8")]) for c in ("keys", "ids", "comps")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for d in sorted(set(right.column("dims").to_pylist()) & set(left.column("dims").to_pylist())):
            copies, names, x = unpack(left, d)
            x = np.repeat(x.reshape(-1, d), copies, axis=0)
            names = np.repeat(names, copies)
            keys, ids, comps = unpack(right, d)
            comps = comps.reshape(-1, d)
            kind = _exact(d, _most(x), _most(comps))
            x = x.astype(kind)
            # a small block first gives the others a k-th best to stop at; copies of a row stay in one block
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
            cuts = np.unique(np.r_[0, starts[np.minimum(np.searchsorted(starts, [256, *range(block_rows, len(x), block_rows)]), len(starts) - 1)], len(x)])
            for at in range(0, len(ids), 1024):
                scan = NoRandomAccess(keys[at : at + 1024], ids[at : at + 1024], comps[at : at + 1024].astype(kind), k)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    scan.block(names[a:b], x[a:b])
                found = scan.best != scan.none
                out.append((np.repeat(scan.keys, found.sum(axis=1)), scan.names[found], scan.best[found].astype(np.int64)))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("key", "vec_id", "score"), joined, strict=True)))

    met = candidates.groupBy("lane", "part").cogroup(questions.groupBy("lane", "part")).applyInArrow(run, "key bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if named is None:
        return top.select(F.col("key").alias("query_id"), "rank", "vec_id", "score")
    return top.join(named.select("key", F.col("vec_id").alias("query_id")), "key").select("query_id", "rank", "vec_id", "score")
