"""Line dedup (operator 3): deletion-neighbourhood join of lines within an edit bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_BASE = 0xD1342543DE82EF95
_DOWN = np.uint64(pow(_BASE, -1, 2**64))
_DOWN_TWICE = np.uint64(pow(_BASE, -2, 2**64))
_MASKED = np.uint64(0x7F4A7C159E3779B9)
MOST_EDITS = 2
PIECES = 16
BLANK = " \t\x0b\f\r"


def _sums(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points; each one's term of the line's polynomial hash; the terms' prefix sums."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    terms = common.mix64(c.astype(np.uint64) + np.uint64(1))
    terms *= common.powers(_BASE, len(c))
    return c, terms, np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))


def neighbourhood(line: str, edits: int, mask: np.ndarray | None = None, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of a line's variants: up to ``edits`` of its characters masked or taken out.

    A key is a 64-bit hash of the variant, in which a masked character is one that no line holds; a
    role is 3 times the number of masked characters and the number of those taken out. Lines of a
    common variant, with m masked and r and s taken out, are within m + r + s edits; lines within
    that many have such a variant. ``mask`` and ``cut`` say at which places (all, without them).
    Time and space grow with the line's length to the power ``edits``.
    """
    c, terms, sums = _sums(line)
    n, total = len(c), sums[-1]
    masked = common.powers(_BASE, n) * _MASKED - terms  # what masking a character adds to the hash
    mask = np.ones(n, bool) if mask is None else mask
    cut = np.ones(n, bool) if cut is None else cut
    keys, roles = [], []

    def add(hashes: np.ndarray, m: int, r: int) -> None:
        found = np.unique(hashes)
        if not len(found):
            return
        keys.append(common.mix64(found ^ common.mix64(np.full(1, n - r, np.uint64))))
        roles.append(np.full(len(found), 3 * m + r, np.int8))

    add(total.reshape(1), 0, 0)
    if edits >= 1:
        i = np.flatnonzero(mask)
        add(total + masked[i], 1, 0)
        i = np.flatnonzero(cut)
        add(sums[i] + (total - sums[i + 1]) * _DOWN, 0, 1)
    if edits >= 2:
        i, j = np.triu_indices(n, 1)
        for first, second in ((mask, mask), (mask, cut), (cut, mask), (cut, cut)):
            use = first[i] & second[j]
            a, b = i[use], j[use]
            if first is mask and second is mask:
                add(total + masked[a] + masked[b], 2, 0)
            elif first is mask:
                add(sums[b] + masked[a] + (total - sums[b + 1]) * _DOWN, 1, 1)
            elif second is mask:
                add(sums[a] + (total - sums[a + 1] + masked[b]) * _DOWN, 1, 1)
            else:
                add(sums[a] + (sums[b] - sums[a + 1]) * _DOWN + (total - sums[b + 1]) * _DOWN_TWICE, 0, 2)
    return np.concatenate(keys).view(np.int64), np.concatenate(roles)


def _bounds(m: int) -> np.ndarray:
    return np.arange(PIECES + 1) * m // PIECES


def outlines(line: str) -> np.ndarray:
    """Hashes of a line without each of its ``PIECES`` pieces: first as it is, then as the longer one
    of two lines, whose piece holds one character more. Lines within one edit share one."""
    _, _, sums = _sums(line)
    n, out = len(sums) - 1, []
    for longer in (0, 1):
        b = _bounds(n - longer)
        hashes = sums[b[:-1]] + (sums[-1] - sums[b[1:] + longer]) * (_DOWN if longer else np.uint64(1))
        out.append(common.mix64(hashes ^ common.mix64(np.arange(PIECES, dtype=np.uint64) + np.uint64((n - longer) << 8))))
    return np.concatenate(out).view(np.int64)


def _pieces(line: Column, edits: int) -> list[Column]:
    """Keys of which two lines within ``edits`` share one: of edits + 1 pieces one is untouched. A line
    is cut by its own length as the shorter of two, and by up to ``edits`` less as the longer one,
    with each piece where the edits before it may have moved it."""
    n, keys = F.length(line), []
    for more in range(edits + 1):
        for j in range(edits + 1):
            moves = [0] if j == 0 else [more] if j == edits else [s for s in range(-edits, 2 * edits + 1) if abs(s) + abs(more - s) <= edits]
            begin, end = (F.floor((n - more) * i / (edits + 1)).cast("int") for i in (j, j + 1))
            keys += [F.xxhash64(n - more, F.lit(j), F.substring(line, begin + 1 + s, end - begin)) for s in moves]
    return keys


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, line, h, g) of every line with a character that isn't white space; h and g
    are two hashes, 128 bits together, that stand for the line."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    rows = docs.select("doc_id", "version", split).where(F.col("line").rlike(r"[^ \t\x0B\f\r]"))
    return rows.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("g"), F.col("line")))


def versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, twins): (doc_id, version, text) of all rows, null texts empty; (doc_id, version, n) of rows
    that are equal to others. The version tells rows of a doc_id apart by their text; it is 0 where
    no doc_id occurs twice."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    again = common.materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "again")
    if common.is_empty(again):
        none = rows.limit(0).select("doc_id", F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("n"))
        return rows.select("doc_id", F.lit(0).cast("long").alias("version"), "text"), none
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text")
    same = rows.select("doc_id", "version").join(again, rows["doc_id"].eqNullSafe(again["id"]), "left_semi")
    return rows, common.materialize(same.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twins")


def repeated_lines(docs: DataFrame, *, edits: int = 1, min_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(lines, near): each distinct line's first place, and the lines that an earlier one makes redundant.

    docs: doc_id, version, text. lines: h, g, doc_id, version, pos, copies. near: h, g of lines of
    ``min_chars`` characters or more with an earlier line (by doc_id, version, position) of such a
    length within ``edits`` edits: characters put in, taken out or replaced.

    Most lines share no piece with another and go at once. With one edit, the others are cut into
    ``PIECES``, and only where two agree but for a piece are that piece's variants made, for the
    variants of another place meet none. Equal variants are joined by key; per key only the earliest
    line of each number of characters taken out is kept, so a key of any number of lines is an
    aggregate and makes no pairs. Each line then has at most one earliest partner, and their edit
    distance is verified on the texts.
    """
    if not 0 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must be 0 to {MOST_EDITS}, not {edits}")
    long_enough = F.length("line") >= min_chars
    keys = [F.when(long_enough, k).alias(f"k{i}") for i, k in enumerate(_pieces(F.col("line"), edits))] if edits else []
    names = [f"k{i}" for i in range(len(keys))]
    first = _lines(docs).select("h", "g", F.struct("doc_id", "version", "pos").alias("at"), *keys)
    first = first.groupBy("h", "g", *names).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    first = common.materialize(first.select("h", "g", "at.doc_id", "at.version", "at.pos", "copies", *names), "lines")
    lines = first.select("h", "g", "doc_id", "version", "pos", "copies")
    if not edits:
        return lines, lines.limit(0).select("h", "g")
    place = ["h", "g", "doc_id", "version", "pos"]
    keyed = first.where("k0 is not null").select(*place, F.explode(F.array_distinct(F.array(*names))).alias("k"))
    shared = common.materialize(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "shared")
    likely = common.by_bitmap(keyed, F.col("k"), *common.bitmap(shared, F.col("k"), shared.count()), True)
    candidates = common.materialize(likely.join(shared, "k", "left_semi").select(*place).distinct(), "candidates")
    n = candidates.count()
    texts = common.materialize(_texts(docs, candidates, n).orderBy("doc_id", "version", "pos").withColumn("rank", F.monotonically_increasing_id()), "texts")
    common.discard(shared, candidates)
    emitted = common.materialize(_variants(texts, n, edits), "variants")
    taken = [F.col("role") % 3 == r for r in range(edits + 1)]
    least = emitted.groupBy("k").agg(*(F.min(F.when(t, F.col("rank"))).alias(f"m{r}") for r, t in enumerate(taken)), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    partner = F.lit(None).cast("long")
    for role in {3 * m + r for m in range(edits + 1) for r in range(edits + 1 - m)}:
        left = edits - role // 3 - role % 3
        best = F.least(*(F.col(f"m{r}") for r in range(left + 1))) if left else F.col("m0")
        partner = F.when(F.col("role") == role, best).otherwise(partner)
    met = emitted.join(least, "k").select("rank", partner.alias("other")).where("other < rank")
    pairs = met.groupBy("rank").agg(F.min("other").alias("other"))
    early = texts.select(F.col("rank").alias("other"), F.col("line").alias("early"))
    near = pairs.join(early, "other").join(texts.select("rank", "line", "h", "g"), "rank").where(F.levenshtein("line", "early", edits) >= 0)
    near = common.materialize(near.select("h", "g"), "near", rows=n)
    common.discard(texts, emitted)
    return lines, near


def _texts(docs: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """(h, g, doc_id, version, pos, line) of the candidates; only texts that hold one are cut into lines,
    and only lines that may be one are joined."""
    doc, line = F.xxhash64("doc_id", "version"), F.xxhash64("h", "g")
    found = _lines(common.by_bitmap(docs, doc, *common.bitmap(candidates, doc, n), True))
    found = common.by_bitmap(found, line, *common.bitmap(candidates, line, n), True)
    at = candidates.select(*(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    same = (found["h"] == at["c_h"]) & (found["g"] == at["c_g"]) & found["doc_id"].eqNullSafe(at["c_doc_id"])
    same &= (found["version"] == at["c_version"]) & (found["pos"] == at["c_pos"])
    return found.join(at, same).select("h", "g", "doc_id", "version", "pos", "line").dropDuplicates(["h", "g"])


def _variants(texts: DataFrame, n: int, edits: int) -> DataFrame:
    """(k, role, rank): the variants of the candidates that another one may share."""
    schema = pa.schema([("k", pa.int64()), ("role", pa.int8()), ("rank", pa.int64())])
    outline_schema = pa.schema([("k", pa.int64()), ("rank", pa.int64()), ("piece", pa.int8())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.arange(2 * PIECES, dtype=np.int8)
        for ranks, lines in common.rows(batches, "rank", "line"):
            made = np.concatenate([outlines(x) for x in lines])
            yield common.batch(outline_schema, [pa.array(made), pa.array(np.repeat(np.array(ranks, np.int64), 2 * PIECES)), pa.array(np.tile(pieces, len(lines)))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, roles, owners, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            made = common.batch(schema, [pa.array(np.concatenate(x)) for x in (keys, roles, owners)])
            for x in (keys, roles, owners):
                x.clear()
            return made

        for ranks, lines, marks in common.rows(batches, "rank", "line", "marks", size=16):
            for rank, line, own in zip(ranks, lines, marks, strict=True):
                k, r = neighbourhood(line, edits, *_places(len(line), own)) if own is not None else neighbourhood(line, edits)
                keys.append(k)
                roles.append(r)
                owners.append(np.full(len(k), rank, np.int64))
                held += len(k)
                if held >= 200_000:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    marked = texts.select("rank", "line", F.lit(None).cast("array<tinyint>").alias("marks"))
    if edits == 1:
        made = common.materialize(common.arrow_map(texts.select("rank", "line"), sketch, "k bigint, rank bigint, piece tinyint"), "outlines")
        longer = F.col("piece") >= PIECES
        met = made.groupBy("k").agg(F.count_if(~longer).alias("short"), F.count_if(longer).alias("long"))
        met = common.materialize(met.where("short > 1 or (short > 0 and long > 0)"), "met", rows=2 * PIECES * n)
        # a piece to be masked has its number, one to lose a character PIECES more, the whole line -1
        what = F.array_compact(F.array(F.when(longer, F.col("piece")).when(F.col("short") > 1, F.col("piece")), F.when(~longer & (F.col("long") > 0), F.lit(-1).cast("tinyint"))))
        marks = made.join(met, "k").select("rank", F.explode(what).alias("mark")).groupBy("rank").agg(F.collect_set("mark").alias("marks"))
        marked = texts.select("rank", "line").join(marks, "rank")
    return common.arrow_map(marked, emit, "k bigint, role tinyint, rank bigint")


def _places(n: int, marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where a line of n characters is masked and cut, of the marks of its pieces."""
    mask, cut = np.zeros(n, bool), np.zeros(n, bool)
    own, longer = _bounds(n), _bounds(n - 1)
    for m in marks:
        if m >= PIECES:
            cut[longer[m - PIECES] : longer[m - PIECES + 1] + 1] = True
        elif m >= 0:
            mask[own[m] : own[m + 1]] = True
    return mask, cut


def deduplicate(docs: DataFrame, *, edits: int = 1, min_chars: int = 20) -> DataFrame:
    """doc_id, text without its redundant lines, n_lines and n_dropped of every row of ``docs``.

    Of equal lines the first of all documents stays (by doc_id, then position), and a line within
    ``edits`` edits (0 to 2) of an earlier line goes, whether that one stays or not. The edit bound
    holds from ``min_chars`` characters on, for an edit makes another statement of a short line
    ("Step 1", "Step 2"); shorter ones go as exact repeats. Blank lines stay; so does the order of
    lines. Null texts are empty ones, with one blank line. Rows of one doc_id are documents of their
    own, in the order of a hash of their text; of equal rows one comes first and the others repeat
    it. An empty table gives no row; other columns are ignored. A line of any length is compared
    whole, at about 50 bytes a character.
    """
    rows, twins = versions(docs)
    lines, near = repeated_lines(rows, edits=edits, min_chars=min_chars)
    near = near.withColumn("near", F.lit(True))
    gone = lines.join(near, ["h", "g"], "left").where("copies > 1 or near")
    gone = gone.select("h", "g", F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("pos").alias("p"), F.coalesce("near", F.lit(False)).alias("near"))
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("pos") == F.col("p")) & ~F.col("near")
    drops = _lines(rows).select("h", "g", "doc_id", "version", "pos").join(common.materialize(gone, "gone"), ["h", "g"]).where(~stays)
    drops = common.materialize(drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops")), "drops")
    key = F.xxhash64("doc_id", "version")
    touched = drops.select("doc_id", "version").union(twins.select("doc_id", "version"))
    bits, places = common.bitmap(touched, key, touched.count())
    some = common.by_bitmap(rows, key, bits, places, True)
    d = drops.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "drops")
    # texts that lose a line are shuffled to their drops at every size, for drops grow with the documents
    some = some.join(d.hint("merge"), some["doc_id"].eqNullSafe(d["d"]) & (some["version"] == d["v"]), "left").select("doc_id", "version", "text", "drops")
    if not common.is_empty(twins):
        t = twins.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("n"))
        counted = some.join(t, some["doc_id"].eqNullSafe(t["d"]) & (some["version"] == t["v"]), "left").dropDuplicates(["doc_id", "version"])
        # the copies of a row lose every line: -1 stands for all
        copies = counted.select("doc_id", "text", "drops", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))).alias("i"))
        some = copies.select("doc_id", "text", F.when(F.col("i") == 1, F.col("drops")).otherwise(F.array(F.lit(-1))).alias("drops"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    mask = docs.sparkSession.sparkContext.broadcast(places)

    def cleaned(ids: list, texts: list[str], drops: list) -> pa.RecordBatch:
        out = []
        for i, t, d in zip(ids, texts, drops, strict=True):
            gone, every = set(d or ()), t.split("\n")
            left = [x for j, x in enumerate(every) if not (j in gone or -1 in gone) or not x.strip(BLANK)] if gone else every
            out.append((i, "\n".join(left) if gone else t, len(every), len(every) - len(left)))
        return common.batch(schema, [list(c) for c in zip(*out, strict=True)])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in common.rows(batches, "doc_id", "text", "drops"):
            yield cleaned(*columns)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~common.set_in(mask.value, b.column(2).to_numpy(zero_copy_only=False))))
            for ids, texts in common.rows(iter([b]), "doc_id", "text"):
                yield cleaned(ids, texts, [None] * len(ids))

    result = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"
    whole = common.arrow_map(rows.select("doc_id", "text", common.bitmap_place(key, bits).alias("place")), untouched, result)
    return whole.unionByName(common.arrow_map(some.select("doc_id", "text", "drops"), rebuild, result))
