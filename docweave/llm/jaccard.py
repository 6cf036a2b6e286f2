"""N-gram Jaccard join (operator 9): size-aware heavy-light join over word shingles, and its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE = common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
_BYTE[65:91] = _BYTE[97:123]  # A to Z count as a to z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = common.mix64(np.arange(16, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
_BLOCK = 1 << 16  # bytes of a text that are hashed at once
_UP, _DOWN = common.powers(_BASE, _BLOCK), common.powers(_INVERSE, _BLOCK)

SUBSET = 2  # tokens of the subsets that small sets enumerate
LARGEST_LIGHT = 64  # the boundary is sought below this size
MASK40 = np.uint64((1 << 40) - 1)
PAIR_ROWS = 512  # narrow rows that a pair of sets weighs as much as
SKETCH_ROWS = 4  # and a set's sketch


def _hashed(raw: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word of at most ``_BLOCK`` bytes, before its length is mixed in; lengths."""
    edge = np.flatnonzero(np.diff(np.r_[True, _SEPARATOR[raw], True].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _UP[: len(raw)])))
    total = (sums[end] - sums[begin]) * _DOWN[np.minimum(begin, _BLOCK - 1)]
    return common.mix64(total + (end - begin).astype(np.uint64) * _PLACES[15])


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's words, in blocks that end between words: a long text needs no more
    room than its words' hashes, and a word of any length is hashed whole."""
    out, at = [], 0
    while at < len(raw):
        block = raw[at : at + _BLOCK]
        if at + _BLOCK < len(raw):
            gaps = np.flatnonzero(_SEPARATOR[block])
            if not len(gaps):  # a word that is longer than a block begins here
                total, size = np.zeros(1, np.uint64), 0
                while len(block) and not (gaps := np.flatnonzero(_SEPARATOR[block])).size:
                    total += np.sum(_BYTE[block] * _UP[: len(block)], dtype=np.uint64) * np.full(1, pow(_BASE, size, 2**64), np.uint64)
                    size += len(block)
                    block = raw[at + size : at + size + _BLOCK]
                block = block[: gaps[0]] if len(block) else block
                total += np.sum(_BYTE[block] * _UP[: len(block)], dtype=np.uint64) * np.full(1, pow(_BASE, size, 2**64), np.uint64)
                size += len(block)
                out.append(common.mix64(total + np.full(1, size, np.uint64) * _PLACES[15]))
                at += size
                continue
            block = block[: gaps[-1] + 1]
        out.append(_hashed(block))
        at += len(block)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words."""
    word = word_hashes(np.frombuffer(common.to_bytes(text or ""), np.uint8))
    if not len(word):
        return word
    n = min(words, len(word))
    total = np.full(len(word) - n + 1, np.uint64(n))
    for j in range(n):
        total += word[j : len(word) - n + 1 + j] * _PLACES[j]
    return np.unique(common.mix64(total))


def _digest(found: np.ndarray, salt: int) -> int:
    total = np.sum(common.mix64(found + np.full(1, salt, np.uint64)), dtype=np.uint64, keepdims=True) + np.full(1, len(found), np.uint64) * _PLACES[14]
    return int(common.mix64(total)[0].astype(np.int64))


def signature(found: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """64-bit hash of a set of hashes, as a signed number. ``clashes`` are hashes that sets of different
    ``second`` hashes share: there both make the signature, so 128 bits tell sets apart."""
    out = _digest(found, 0xA5A5)
    return out ^ second(found) if out in clashes else out


def second(found: np.ndarray) -> int:
    return _digest(found, 0x5A5A5A5A)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes in as many bits as the power of two from its size on (64 at least).

    The Hamming distance of two sketches is at most the size of the sets' symmetric difference, and
    so is that of a sketch and one twice as long folded in half.
    """
    bits = 1 << max(6, (len(found) - 1).bit_length())
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


@dataclass(frozen=True)
class Plan:
    """What every task must agree on to index sets alike."""

    percent: int
    words: int
    boundary: int  # sets below are small
    buckets: int
    heavy: np.ndarray  # sorted hashes of frequent shingles
    rank: np.ndarray  # their places in the order, after all others
    clashes: frozenset[int] = frozenset()
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted shingles of very long lists
    parts: int = 1  # in which those lists are scanned

    @property
    def smallest(self) -> int:
        """Least size of a set that links with a different one: n of n + 1 shingles is the best it can do."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 62

    def least(self, n: int) -> int:
        """Least intersection of a set of n with any set it links with."""
        return -(-self.percent * n // 100)

    def ordered(self, found: np.ndarray) -> np.ndarray:
        """The set in the global order: infrequent shingles by hash, then frequent ones, rarest first."""
        if not len(self.heavy):
            return found
        at = np.minimum(np.searchsorted(self.heavy, found), len(self.heavy) - 1)
        frequent = self.heavy[at] == found
        if not frequent.any():
            return found
        late, rank = found[frequent], self.rank[at[frequent]]
        return np.concatenate((found[~frequent], late[np.argsort(rank)]))

    def keys(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, reach, hot) under which a set is indexed.

        Two sets that link have an intersection of at least ``least``. Large sets: their first
        common shingle is among the first n - least + 1 of each, so those are keys (the inverted
        lists). Small sets: their first SUBSET common ones are among the first n - least + SUBSET,
        so all subsets of that size are keys; where fewer than SUBSET common ones may do, they are
        in the lists as well. ``reach`` bounds the intersection of a pair whose first common
        shingles are those of the key: what is left from there on. A key is hot if all its shingles are.
        """
        n, order = len(found), self.ordered(found)
        least = self.least(n)
        keys, reach, hot = [], [], []
        at = np.minimum(np.searchsorted(self.hot, order), max(len(self.hot) - 1, 0))
        much = self.hot[at] == order if len(self.hot) else np.zeros(n, bool)
        if n < self.boundary:
            first = order[: n - least + SUBSET]
            i, j = np.triu_indices(len(first), 1)
            keys.append(common.mix64(first[i] * _PLACES[11] + first[j] * _PLACES[12]))
            reach.append(n - j + 1)
            hot.append(much[i] & much[j])
        if least < SUBSET or 100 * n >= self.percent * self.boundary or n >= self.boundary:
            m = n - least + 1
            keys.append(order[:m])
            reach.append(n - np.arange(m))
            hot.append(much[:m])
        return np.concatenate(keys), np.concatenate(reach), np.concatenate(hot)


def required(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of sizes a and b whose Jaccard similarity is percent / 100."""
    return -(-(percent * (a + b)) // (100 + percent))


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: (doc_id, shingles, signature and second hash, sketch) of each row; kind 1: (hash, count) of
    shingles that a task saw often; kind 2: sums of a task's counts and their squares."""
    schema = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, often, seen = 0, {}, set()
        squares = totals = 0

        def count() -> None:
            nonlocal size, squares, totals
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                squares, totals = squares + int((c * c).sum()), totals + int(c.sum())
                top = np.flatnonzero(c >= 2)
                top = top[np.argsort(-c[top], kind="stable")[: 1 << 15]]
                for a, b in zip(h[top].tolist(), c[top].tolist(), strict=True):
                    often[a] = often.get(a, 0) + b
            held.clear()
            size = 0

        for ids, texts in common.rows(batches, "doc_id", "text"):
            found = [shingles(t, words) for t in texts]
            sigs = [signature(f) for f in found]
            yield common.batch(schema, [[0] * len(ids), ids, [len(f) for f in found], sigs, [second(f) for f in found], [sketch(f) for f in found]])
            for f, s in zip(found, sigs, strict=True):
                if s not in seen:  # equal sets count once a task
                    seen.add(s)
                    held.append(f)
                    size += len(f)
            if size > 1_000_000:
                count()
                seen.clear()
        count()
        top = sorted(often.items(), key=lambda x: (-x[1], x[0]))[: 1 << 15]
        hashes = np.array([h for h, _ in top], np.uint64).view(np.int64).tolist()
        yield common.batch(schema, [[1] * len(top) + [2], hashes + [totals], [c for _, c in top] + [squares], [0] * (len(top) + 1), [0] * (len(top) + 1), [None] * (len(top) + 1)])

    return common.arrow_map(docs.select("doc_id", "text"), run, "kind int, x bigint, n bigint, sig bigint, sig2 bigint, sketch array<bigint>")


def _boundary(sizes: dict[int, int], mean_list: float, percent: int) -> int:
    """The size below which enumerating subsets costs less than scanning lists, by a cost of one for
    each key emitted and each list entry met."""
    least = lambda n: -(-percent * n // 100)
    light = lambda n: (n - least(n) + SUBSET) * (n - least(n) + SUBSET - 1) / 2
    heavy = lambda n: (n - least(n) + 1) * (1 + mean_list)
    best, at = None, 3
    for x in range(3, LARGEST_LIGHT + 1):
        cost = sum(k * (light(n) * (n < x) + heavy(n) * (100 * n >= percent * x)) for n, k in sizes.items() if n >= 3)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, packed): each task's index entries, dealt into buckets by key. Those of hot keys are dealt
    by set as well: bucket b's into b + buckets, b + 2 buckets, and so on."""
    schema = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reach, much, sigs, sizes = [], [], [], [], []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            k = np.concatenate(keys)
            r, lens = np.concatenate(reach).astype("<u4"), [len(x) for x in keys]
            s, n = np.repeat(np.array(sigs, "<i8"), lens), np.repeat(np.array(sizes, "<u4"), lens)
            bucket, hot = (k >> np.uint64(40)) % np.uint64(plan.buckets), np.concatenate(much)
            if hot.any():
                part = common.mix64(s[hot].astype(np.uint64) + _PLACES[10]) % np.uint64(plan.parts)
                bucket[hot] += (part + np.uint64(1)) * np.uint64(plan.buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, k, r, s, n = bucket[order], (k & MASK40)[order], r[order], s[order], n[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = [*cuts[1:].tolist(), len(k)]
            low, high = (k & np.uint64(0xFFFFFFFF)).astype("<u4"), (k >> np.uint64(32)).astype("u1")
            for x in (keys, reach, much, sigs, sizes):
                x.clear()
            packed = [b"".join(x[a:b].tobytes() for x in (s, low, n, r, high)) for a, b in zip(cuts.tolist(), ends, strict=True)]
            return common.batch(schema, [bucket[cuts].astype(np.int64).tolist(), packed])

        held = 0
        for (texts,) in common.rows(batches, "text"):
            for t in texts:
                found = shingles(t, plan.words)
                if len(found) < plan.smallest:
                    continue
                sig = signature(found, plan.clashes)
                if sig in seen:
                    continue
                seen.add(sig)
                k, r, hot = plan.keys(found)
                keys.append(k)
                reach.append(r)
                much.append(hot)
                sigs.append(sig)
                sizes.append(len(found))
                held += len(k)
            if held > 250_000:
                yield flush()
                held = 0
            if len(seen) > 200_000:
                seen.clear()
        if keys:
            yield flush()

    return common.arrow_map(docs.select("text"), run, "bucket bigint, packed binary")


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for raw in parts:
        m, at = len(raw) // 21, 0
        for i, (kind, width) in enumerate((("<i8", 8), ("<u4", 4), ("<u4", 4), ("<u4", 4), ("u1", 1))):
            out[i].append(np.frombuffer(raw, kind, m, at))
            at += m * width
    sig, low, n, r, high = (np.concatenate(x) for x in out)
    return high.astype(np.int64) << 32 | low.astype(np.int64), sig, n.astype(np.int64), r.astype(np.int64)


def _lists(postings: DataFrame, percent: int, buckets: int) -> DataFrame:
    """From the buckets, of each key met by two sets at least: kind 0, a pair (x, y) of the list's
    first set and another that may link; kind 1, entries (list, set, size, reach) of longer lists.
    Of a hot list a task sees a part, so all its entries are kind 1, and its first is kind 2 as well."""

    def scan(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        hot = bucket >= buckets
        key, sig, n, r = _unpack(table.column("packed").to_pylist())
        order = np.lexsort((sig, -r, key))
        key, sig, n, r = key[order], sig[order], n[order], r[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]  # copies of a set have one reach
        key, sig, n, r = key[fresh], sig[fresh], n[fresh], r[fresh]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[begin, len(key)])
        group = np.repeat(np.arange(len(begin)), length)
        # no partner as small as the list's smallest set could do: out
        most = (100 + percent) * r // percent - n
        keep = ((length[group] > 1) & (np.minimum.reduceat(n, begin)[group] <= most)) | hot
        key, sig, n, r = key[keep], sig[keep], n[keep], r[keep]
        if not len(key):
            return pa.table({c: pa.array([], pa.int64()) for c in ("kind", "list", "x", "y", "n", "r")})
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[begin, len(key)])
        head = np.repeat(begin, length)
        pair = (np.arange(len(key)) > head) & (np.minimum(r, r[head]) >= required(n, n[head], percent))
        more = (np.repeat(length, length) > 2) | hot
        first = begin[: len(begin) if hot else 0]
        zero = np.zeros(int(pair.sum()), np.int64)
        name = common.mix64(key.astype(np.uint64) + np.full(1, bucket % buckets, np.uint64) * _PLACES[13]).view(np.int64)
        x, y = np.minimum(sig, sig[head])[pair], np.maximum(sig, sig[head])[pair]
        return pa.table(
            {
                "kind": np.r_[zero, np.ones(int(more.sum()), np.int64), np.full(len(first), 2)],
                "list": np.r_[zero, name[more], name[first]],
                "x": np.r_[x, sig[more], sig[first]],
                "y": np.r_[y, np.zeros(int(more.sum()) + len(first), np.int64)],
                "n": np.r_[zero, n[more], n[first]],
                "r": np.r_[zero, r[more], r[first]],
            }
        )

    return postings.groupBy("bucket").applyInArrow(common.trimmed(scan), "kind bigint, list bigint, x bigint, y bigint, n bigint, r bigint")


def _between_parts(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a hot list's first set and the first ones of its parts, if they may link."""
    best = heads.groupBy("list").agg(F.max(F.struct("r", "x", "n")).alias("b")).select(F.col("list").alias("of"), "b.*")
    best = best.select("of", F.col("r").alias("br"), F.col("x").alias("bx"), F.col("n").alias("bn"))
    both = heads.join(best, F.col("list") == F.col("of")).where("x <> bx")
    both = both.where(F.least("r", "br") * (100 + percent) >= percent * (F.col("n") + F.col("bn")))
    return both.select(F.least("x", "bx").alias("x"), F.greatest("x", "bx").alias("y"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sketches don't rule a link out: exact, as a sketch never overstates
    the symmetric difference. It needs about a bit for each shingle instead of eight bytes."""
    one = classes.select(F.col("sig").alias("x"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("sx"))
    two = classes.select(F.col("sig").alias("y"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("sy"))

    def folded(a: str, b: str) -> Column:
        """Column a, folded in half if it is longer than column b."""
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))

    both = pairs.select("x", "y").join(two, "y").join(one, "x")
    near = F.greatest(F.size("sx"), F.size("sy")) <= 2 * F.least(F.size("sx"), F.size("sy"))
    apart = F.aggregate(F.zip_with(folded("sx", "sy"), folded("sy", "sx"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return both.where(near & (apart * (100 + percent) <= (100 - percent) * (F.col("nx") + F.col("ny")))).select("x", "y")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, plan: Plan, n_rows: int) -> DataFrame:
    """The pairs (x, y) of ``pairs`` that link, by the sizes of their true intersections.

    Only texts of sets in a pair are made into sets again: a bounded bitmap of their ids filters
    most rows, a join on the signature the rest.
    """
    n_pairs = pairs.count()
    ends = pairs.select(F.col("x").alias("sig")).union(pairs.select("y")).distinct()
    used = common.materialize(ends.join(classes.select("sig", "rep"), "sig"), "used", rows=n_rows)
    bits, places = common.bitmap(used, F.col("rep"), used.count())
    shared = docs.sparkSession.sparkContext.broadcast(places)
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("found", pa.list_(pa.int64()))])
    words, clashes = plan.words, plan.clashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(common.set_in(shared.value, b.column(2).to_numpy(zero_copy_only=False))))
            for ids, texts in common.rows(iter([b]), "doc_id", "text", size=64):
                found = [shingles(t, words) for t in texts]
                yield common.batch(schema, [ids, [signature(f, clashes) for f in found], [f.view(np.int64) for f in found]])

    made = common.arrow_map(docs.select("doc_id", "text", common.bitmap_place(F.col("doc_id"), bits).alias("place")), run, "doc_id bigint, sig bigint, found array<bigint>")
    wanted = used.withColumnRenamed("sig", "used")
    sets = made.join(wanted, (made["sig"] == wanted["used"]) & made["doc_id"].eqNullSafe(wanted["rep"])).select("sig", "found")
    sets = common.materialize(sets, "sets")
    left = sets.select(F.col("sig").alias("x"), F.col("found").alias("fx"))
    right = sets.select(F.col("sig").alias("y"), F.col("found").alias("fy"))
    both = pairs.select("x", "y").join(right, "y").join(left, "x")
    common_size = F.size(F.array_intersect("fx", "fy"))
    links = both.where(common_size * (100 + plan.percent) >= plan.percent * (F.size("fx") + F.size("fy")))
    links = common.materialize(links.select("x", "y").distinct(), "links", rows=PAIR_ROWS * n_pairs)
    common.discard(used, sets)
    return links


def _apart(one: np.ndarray, others: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, distances) of a sketch to the sketches, by length, that are as long, half or twice as long."""
    size = len(one)
    for length, (rows, sketches) in others.items():
        if length == size:
            yield rows, np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)
        elif 2 * length == size:
            yield rows, np.bitwise_count(sketches ^ (one[:length] ^ one[length:])).sum(axis=1, dtype=np.int64)
        elif length == 2 * size:
            yield rows, np.bitwise_count(sketches[:, :size] ^ sketches[:, size:] ^ one).sum(axis=1, dtype=np.int64)


def _cross_pairs(entries: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, buckets: int, n_entries: int, cell_rows: int = 4096) -> DataFrame:
    """Pairs of a list whose sets are in different components so far and that may still link, by what
    is left of them from the list's shingle on and by their sketches.

    Lists with the same sets are taken as one, with the largest reach of each set. A list of more
    than ``cell_rows`` sets is dealt into parts, and each two parts (and each part with itself) meet
    in a cell, so no task holds a long list or compares it whole.
    """
    labelled = entries.join(labels.select(F.col("node").alias("x"), "label"), "x", "left").select("list", "x", "n", "r", F.coalesce("label", "x").alias("label"))
    mixed = labelled.groupBy("list").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor(F.xxhash64("x")).alias("h"), F.count(F.lit(1)).alias("size"))
    mixed = common.materialize(mixed.where("a <> b").select("list", "h", F.ceil(F.col("size") / cell_rows).cast("int").alias("parts")), "mixed", rows=n_entries)
    rows = labelled.join(mixed, "list").groupBy("h", "x").agg(F.max("r").alias("r"), F.first("n").alias("n"), F.first("label").alias("label"), F.max("parts").alias("parts"))
    rows = rows.join(classes.select(F.col("sig").alias("x"), "sketch"), "x")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("h", F.least("part", "other"), F.greatest("part", "other")))
    # in a cell of one part with itself every pair is new, in one of two parts only those across
    rows = rows.withColumn("side", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part"))).withColumn("bucket", F.pmod(F.col("cell"), F.lit(buckets)))
    empty = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})

    def scan(table: pa.Table) -> pa.Table:
        name, x, n, r, label, side = (table.column(c).to_numpy() for c in ("cell", "x", "n", "r", "label", "side"))
        order = np.lexsort((label, name))
        sketches = table.column("sketch").combine_chunks()
        flat, ends = sketches.flatten().to_numpy().view(np.uint64), np.asarray(sketches.offsets)
        ends = ends - ends[0]
        name, x, n, r, label, side = name[order], x[order], n[order], r[order], label[order], side[order]
        cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        out: list[np.ndarray] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(name)], strict=True):
            own = [flat[ends[k] : ends[k + 1]] for k in order[a:b]]
            lengths = np.array([len(k) for k in own])
            by_length = {int(m): (at, np.stack([own[k] for k in at])) for m in np.unique(lengths) for at in [np.flatnonzero(lengths == m)]}
            xs, ns, rs, ls, ss = x[a:b], n[a:b], r[a:b], label[a:b], side[a:b]
            names, sizes = np.unique(ls, return_counts=True)
            largest = names[np.argmax(sizes)]
            for i in np.flatnonzero(ls != largest).tolist():  # the largest one's pairs are seen from the other side
                for rows, apart in _apart(own[i], by_length):
                    ok = (ls[rows] != ls[i]) & (np.minimum(rs[rows], rs[i]) >= required(ns[rows], ns[i], percent))
                    ok &= (ls[rows] == largest) | (xs[rows] > xs[i])
                    ok &= (ss[rows] != ss[i]) | (ss[i] == -1)
                    ok &= apart * (100 + percent) <= (100 - percent) * (ns[rows] + ns[i])
                    if ok.any():
                        j = rows[ok]
                        out.append(np.column_stack((np.minimum(xs[i], xs[j]), np.maximum(xs[i], xs[j]))))
        if not out:
            return empty
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"x": found[:, 0], "y": found[:, 1]})

    return rows.groupBy("bucket").applyInArrow(common.trimmed(scan), "x bigint, y bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large and small stars.

    Every round is a written table; rounds grow with the logarithm of the longest chain. Nothing
    but two counts comes to the driver.
    """
    ends = [F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")]
    n = 2 * edges.count()  # no round has more edges than the first
    now = common.materialize(edges.where("x <> y").select(*ends).distinct(), "edges", rows=n)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars", rows=n)
        # done when each node has one edge, to a node that is nobody's leaf
        leaves = after.select("u")
        done = after.count() == leaves.distinct().count() and common.is_empty(after.join(leaves.select(F.col("u").alias("v")), "v", "left_semi"))
        common.discard(now)
        now = after
        if done:
            break
    labels = common.materialize(now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct()), "labels", rows=n)
    common.discard(now)
    return labels


def join(docs: DataFrame, *, percent: int = 75, words: int = 5, bucket_entries: int = 400_000, most_frequent: int = 1 << 17, cell_rows: int = 4096, hot_entries: int = 1_600_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of other than ASCII white space, with A-Z lower-cased; a set holds the distinct
    shingles of ``words`` words (a shorter text is one shingle; no word or null text: an empty set,
    linked with nothing). Two rows link when 100 * intersection >= percent * union; component_id is
    the least doc_id that links reach. Rows with equal sets are one class and are compared once;
    null ids count as larger than any; an empty table gives no row; other columns play no part. Texts
    are hashed in blocks, so one of any length needs 24 bytes a word. ``percent`` is 50 to 100, where
    the sketches' rule is exact.

    1. A first pass makes each row's set size and signature, and finds frequent shingles, which
       come last in the order of the sets (a hint of at most ``most_frequent``; any order is right).
    2. Sets are indexed by the heavy-light scheme of ``Plan.keys``; entries travel packed, in
       buckets of about ``bucket_entries``, so few rows cross the shuffle, each once a task. Lists of
       shingles seen ``hot_entries`` times are dealt into parts by set, so no task holds a long list.
    3. Each list proposes its first set with each of the others; the best two proposals of a set
       are verified, by sketches that rule most out and then on true sets. Their components are found.
    4. Lists that still hold sets of different components propose all pairs across them that the
       bound on the intersection admits; these are verified as well, so no link is lost, while a
       group of copies that already hangs together makes no pairs.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be 50 to 100, not {percent}")
    profile = common.materialize(_profile(docs, words), "profile")
    rows = profile.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("n").alias("n_shingles"), "sig", "sig2", "sketch")
    n_rows = rows.count()

    def grouped(rows: DataFrame) -> DataFrame:
        aggs = (F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"), F.min("sig2").alias("low"), F.max("sig2").alias("high"))
        return common.materialize(rows.where("n_shingles > 0").groupBy("sig").agg(*aggs), "classes", rows=SKETCH_ROWS * n_rows)

    classes = grouped(rows)
    clashes = frozenset(r.sig for r in classes.where("low <> high").select("sig").collect())  # about n * n / 2 ** 65 of n sets
    if clashes:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*clashes), F.col("sig").bitwiseXOR(F.col("sig2"))).otherwise(F.col("sig")))
        classes = grouped(rows)
    frequent = profile.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n"), "x").limit(most_frequent).collect()
    sums = profile.where("kind = 2").agg(F.sum("x"), F.sum("n")).first()
    small = {r.n_shingles: r.n for r in classes.where(F.col("n_shingles") <= 2 * LARGEST_LIGHT).groupBy("n_shingles").agg(F.count(F.lit(1)).alias("n")).collect()}
    boundary = _boundary(small, (sums[1] or 0) / max(sums[0] or 0, 1), percent)
    least = F.ceil(F.col("n_shingles") * percent / 100)
    keys = F.when(F.col("n_shingles") < boundary, (F.col("n_shingles") - least + SUBSET) ** 2 / 2).otherwise(F.col("n_shingles") - least + 1)
    entries = classes.agg(F.sum(keys)).first()[0] or 0
    by_hash = np.array([r.x for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(by_hash)
    rank = np.array([-r.n for r in frequent], np.int64)
    rank = np.argsort(np.lexsort((by_hash, -rank))) if len(rank) else rank
    plan = Plan(percent, words, boundary, max(8, int(entries / bucket_entries) + 1), by_hash[order], rank[order] if len(order) else rank, clashes)
    much = [r for r in frequent if r.n >= hot_entries]
    if much:
        parts = min(plan.buckets, sum(r.n for r in much) // bucket_entries + 2)
        plan = replace(plan, hot=np.sort(np.array([r.x for r in much], np.int64).view(np.uint64)), parts=parts)

    lists = common.materialize(_lists(_postings(docs, plan), percent, plan.buckets), "lists")
    proposed = lists.where("kind = 0").select("x", "y").unionByName(_between_parts(lists.where("kind = 2"), percent)) if plan.parts > 1 else lists.where("kind = 0")
    proposed = proposed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    kinds = {r.kind: r["count"] for r in lists.groupBy("kind").count().collect()}
    n_proposed = sum(kinds.get(k, 0) for k in (0, 2))
    ends = proposed.select("x", "y", "n", F.explode(F.array("x", "y")).alias("z"))
    best = Window.partitionBy("z").orderBy(F.desc("n"), "x", "y")
    stars = common.materialize(ends.withColumn("i", F.row_number().over(best)).where("i <= 2").select("x", "y").distinct(), "stars", rows=2 * n_proposed)
    likely = common.materialize(_plausible(stars, classes, percent), "likely", rows=SKETCH_ROWS * (n_rows + 2 * n_proposed))
    links = _verified(docs, likely, classes, plan, n_rows)
    common.discard(likely)
    labels = components(links)
    # every proposal not verified yet, and every other pair across components
    rest = proposed.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x", "left").join(labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y", "left")
    rest = rest.where(~F.coalesce("lx", "x").eqNullSafe(F.coalesce("ly", "y"))).select("x", "y")
    cross = _cross_pairs(lists.where("kind = 1").select("list", "x", "n", "r"), labels, classes, percent, plan.buckets, kinds.get(1, 0), cell_rows)
    late = common.materialize(_plausible(rest.union(cross).distinct().join(stars, ["x", "y"], "left_anti"), classes, percent), "late")
    common.discard(lists, stars)
    if not common.is_empty(late):
        labels = components(links.union(_verified(docs, late, classes, plan, n_rows)))
    joined = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", "copies", F.coalesce("label", "sig").alias("label"))
    least_id = joined.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("sets"), F.max("copies").alias("most"))
    told = common.materialize(joined.join(least_id.where("sets > 1 or most > 1"), "label").select("sig", "copies", "component_id"), "told", rows=n_rows)
    common.discard(classes, links, late, labels)
    out = common.join_hot(rows.drop("sketch", "sig2"), told, "sig", "copies", n_rows)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
