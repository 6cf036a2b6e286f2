"""Packing (operator 2): sum-of-squares online packing of token ids into windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, piece_ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("piece_ids", pa.binary())])


#: Ids compress, but no two pieces are equal: a light codec and no dictionary.
PIECES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}


@dataclass
class SumOfSquares:
    """Online packer of items of 1 to ``capacity`` units into windows of ``capacity`` units.

    ``levels[h]`` counts the open windows filled to exactly h (0 < h < capacity). An item of size w
    goes where the sum of the squared counts becomes least: opening a window changes that sum by
    2 N(w) + 1, and using one at level h by 2 (N(h + w) - N(h)) + 2, or 1 - 2 N(h) if it gets full.
    Ties go to the fullest level. Time is O(capacity) an item, vectorised; memory is the level
    array and the open windows.
    """

    capacity: int
    levels: np.ndarray = field(init=False)
    open: dict[int, list[int]] = field(init=False)
    made: int = 0

    def __post_init__(self) -> None:
        self.levels = np.zeros(self.capacity + 1, np.int64)
        self.open = {}

    def place(self, w: int) -> tuple[int, int]:
        """(window, offset) of an item of size w."""
        n, c = self.levels, self.capacity
        if w == c:
            self.made += 1
            return self.made - 1, 0
        cost = 2 * (n[w + 1 : c + 1] - n[1 : c - w + 1]) + 2
        cost[-1] -= 1  # a window that gets full leaves no level behind: n[c] stays 0
        cost[n[1 : c - w + 1] == 0] = np.iinfo(np.int64).max
        at = len(cost) - 1 - int(np.argmin(cost[::-1])) if len(cost) else -1
        if at < 0 or cost[at] > 2 * n[w] + 1:
            h, window = 0, self.made
            self.made += 1
        else:
            h = at + 1
            window = self.open[h].pop()
            n[h] -= 1
        if h + w < c:
            n[h + w] += 1
            self.open.setdefault(h + w, []).append(window)
        return window, h


def close(capacity: int, windows: list[list[tuple]]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """(full, open) windows at the end of a stream: one joins one or two others that fill it exactly,
    the fullest first, found in the array of windows by level."""
    by_level: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
    for w in windows:
        by_level[sum(p[2] for p in w)].append(w)
    count = np.array([len(x) for x in by_level])
    full, left = [], []
    for h in range(capacity - 1, 0, -1):
        while by_level[h]:
            own, room = by_level[h].pop(), capacity - h
            count[h] -= 1
            a = np.arange(1, room // 2 + 1)
            two = a[(count[a] > 0) & (count[room - a] > (2 * a == room))]
            others = [room] if count[room] else [room - two[-1], two[-1]] if len(two) else []
            for level in others:
                own = own + by_level[level].pop()
                count[level] -= 1
            (full if others else left).append(own)
    return full, left


def pack(docs: DataFrame, *, window: int = 1024, vocabulary: str | None = None, lane_rests: int = 16_384, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """One row per piece: where the ids ``start`` .. ``start + length`` of a document lie.

    A document's ids are those of its whole text and then id 0 (so an empty or null text has one
    id). It is cut into full windows and a rest; rests are placed by ``SumOfSquares``. Each task
    packs its own rows as they come, and writes them. Rests of windows that are open at its end (some
    1,500, whatever the task's size) go through one small exchange into lanes of about
    ``lane_rests``, where the same rule places them, the longest first. Of the rests in windows that a lane leaves open,
    two or three that fill a window exactly join (``close``); only the others are laid end to end
    and cut into full windows, and the last of them into powers of two, so nothing is padded. ``piece_ids`` has the piece's ids as little-endian unsigned 32-bit numbers.

    Rows are packed as they are: repeated rows, ties and null ids get pieces each; a text of any
    length is encoded whole; other columns are ignored; an empty table gives no row.
    ``remembered`` bounds the words that a worker keeps the ids of (memory against time). ``sequence_id`` is the number of the task or lane that filled the window times 2**32 plus a
    running number, lanes from 2**62 on, so a repeated task gives the same ids.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def flush(out: list[tuple]) -> pa.RecordBatch:
        made = common.batch(_ARROW, [list(c) for c in zip(*out, strict=True)])
        out.clear()
        return made

    def place(packer: SumOfSquares, held: dict[int, list[tuple]], piece: tuple, first: int, out: list[tuple]) -> None:
        where, offset = packer.place(piece[2])
        held.setdefault(where, []).append(piece)
        if offset + piece[2] == packer.capacity:
            out.extend(_laid(held.pop(where), first + where))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, remembered).many
        packer, held, out = SumOfSquares(window), {}, []
        first = _task() << 32
        for ids, texts in common.rows(batches, "doc_id", "text"):
            for doc_id, raw in zip(ids, encode([t or "" for t in texts]), strict=True):
                raw += tokens.END
                n = len(raw) // 4
                full = n - n % window
                for at in range(0, full, window):
                    out.append((doc_id, at, window, n, first + packer.place(window)[0], 0, raw[4 * at : 4 * (at + window)]))
                if full < n:
                    place(packer, held, (doc_id, full, n - full, n, None, None, raw[4 * full :]), first, out)
                if len(out) >= 512:
                    yield flush(out)
        out.extend(p for pieces in held.values() for p in pieces)
        if out:
            yield flush(out)

    def lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, out = SumOfSquares(window), {}, []
        first = (1 << 62) + (_task() << 32)
        for columns in common.rows(batches, *_ARROW.names):
            for piece in zip(*columns, strict=True):
                place(packer, held, piece, first, out)
            if len(out) >= 512:
                yield flush(out)
        full, left = close(window, [[p] for pieces in held.values() for p in pieces])
        for number, pieces in enumerate(full, first + packer.made):
            out.extend(_laid(pieces, number))
        out.extend(_relay(left, window, first + packer.made + len(full)))
        if out:
            yield flush(out)

    placed = common.materialize(common.arrow_map(docs.select("doc_id", "text"), run, SCHEMA), "pieces", **PIECES)
    rests = placed.where("sequence_id is null")
    lanes = rests.count() // lane_rests + 1
    dealt = rests.repartition(lanes).sortWithinPartitions(F.desc("length"), "doc_id", "start")
    return placed.where("sequence_id is not null").unionByName(common.arrow_map(dealt, lane, SCHEMA))


def _task() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _laid(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    """The pieces of a window, one after another."""
    offset = 0
    for doc_id, start, length, n, _, _, raw in pieces:
        yield doc_id, start, length, n, sequence, offset, raw
        offset += length


def _relay(windows: list[list[tuple]], window: int, next_id: int) -> Iterator[tuple]:
    """The pieces of windows that stayed open, cut anew into full windows and then powers of two."""
    pieces = [p for w in windows for p in w]
    left = sum(p[2] for p in pieces)
    sizes = [window] * (left // window) + [1 << b for b in range((left % window).bit_length() - 1, -1, -1) if left % window >> b & 1]
    room, offset, sequence = 0, 0, next_id - 1
    for doc_id, start, length, n, _, _, raw in pieces:
        done = 0
        while done < length:
            if not room:
                room, offset, sequence = sizes.pop(0), 0, sequence + 1
            take = min(room, length - done)
            yield doc_id, start + done, take, n, sequence, offset, raw[4 * done : 4 * (done + take)]
            done, room, offset = done + take, room - take, offset + take
