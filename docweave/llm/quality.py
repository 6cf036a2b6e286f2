"""Quality classifier (operator 10): naive Bayes scaled n-gram indicators, linear SVM by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Character classes of bytes: other, space, line break, lower, upper, digit, beyond ASCII; punctuation keeps its own code.
_CLASS = np.zeros(256, np.uint32)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[128:] = 3
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 8 + _c

_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def _hash(parts: list[np.ndarray], salt: int, bits: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for p, k in zip(parts, _K, strict=False):
        h = (h ^ p) * k
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << bits) - 1)


def indicators(text: str, bits: int) -> np.ndarray:
    """Sorted distinct indices below 2 ** bits of a text's n-grams.

    N-grams are of byte trigrams (lower-cased ASCII), of runs of character classes (1 to 4 in a
    row, with each run's length up to 3 and capped classes of it), and of words' shapes (1 to 3 in
    a row: length class, first and last class, and whether the word equals the one before or the
    one before that). A run or shape n-gram that makes up more than 2, 8 or 32 % of a text's is an
    indicator of its own, so that long texts don't show every n-gram alike.
    """
    raw = np.frombuffer(common.to_bytes(text), np.uint8)
    if not len(raw):
        return np.zeros(1, np.uint32)
    out = []
    low = raw + ((raw >= 65) & (raw < 91)).astype(np.uint8) * np.uint8(32)
    b = low.astype(np.uint32)
    if len(b) >= 3:
        out.append(_hash([b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)], 1, bits))
    c = _CLASS[raw]
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    length = np.diff(np.r_[starts, len(c)])
    runs = c[starts] * np.uint32(4) + np.minimum(length, 3).astype(np.uint32)
    shares = [_hash([runs[i : len(runs) - n + 1 + i] for i in range(n)], 2 + n, bits) for n in (1, 2, 3, 4) if len(runs) >= n]
    blank = (c == 1) | (c == 2)
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        place = np.cumsum(b.astype(np.uint64) * common.mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[low])
        total = place[end - 1] - np.where(begin > 0, place[begin - 1], np.uint64(0))
        size = end - begin
        same = np.zeros(len(begin), np.uint32)
        for back in (1, 2):
            same[back:] |= ((total[back:] == total[:-back]) & (size[back:] == size[:-back])).astype(np.uint32) * np.uint32(back)
        shape = np.minimum(np.log2(size + 1), 7).astype(np.uint32) | c[begin] << np.uint32(3) | c[end - 1] << np.uint32(12) | same << np.uint32(21)
        shares += [_hash([shape[i : len(shape) - n + 1 + i] for i in range(n)], 10 + n, bits) for n in (1, 2, 3) if len(shape) >= n]
    for h in shares:
        found, n = np.unique(h, return_counts=True)
        out.append(found)
        for level, share in enumerate((0.02, 0.08, 0.32), 1):
            out.append(_hash([found[n > share * len(h)]], 20 + level, bits))
    return np.unique(np.concatenate(out))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, *, epochs: int = 20, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM with hinge loss, by coordinate descent on its dual: one row's multiplier
    at a time is moved to where its gradient is 0, and kept between 0 and the row's cost.

    ``rows`` are the indices of ones; a row is ``values`` there, divided by the root of their number.
    ``y`` is -1 or 1; ``cost`` is each row's C.
    """
    w, alpha = np.zeros(len(values)), np.zeros(len(rows))
    scaled = [values[r] / np.sqrt(len(r)) for r in rows]
    q = np.array([float(s @ s) for s in scaled])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * float(w[rows[i]] @ scaled[i]) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            if abs(projected) > 1e-9 and q[i] > 0:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
                w[rows[i]] += (new - alpha[i]) * y[i] * scaled[i]
                alpha[i] = new
        if worst < tolerance:
            break
    return w


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # ratio times SVM weight, divided by the root of the number of indicators when applied
    bits: int
    slope: float
    bias: float

    def margin(self, text: str) -> float:
        found = indicators(text, self.bits)
        return float(self.weights[found].sum() / np.sqrt(len(found)))


def _train(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float, c: float) -> np.ndarray:
    ratio = np.zeros((2, 1 << bits))
    for r, k in zip(rows, y, strict=True):
        ratio[int(k), r] += 1
    ratio += alpha
    ratio = np.log(ratio[1] / ratio[1].sum()) - np.log(ratio[0] / ratio[0].sum())
    sign = np.where(y > 0, 1.0, -1.0)
    cost = c * 0.5 / np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    return ratio * dual_coordinate_descent(rows, ratio, sign, cost)


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = 8_000, bits: int = 18, alpha: float = 1.0, c: float = 1.0) -> QualityModel:
    """Fit on about ``max_documents`` labelled rows outside the held-out fold.

    Indicators are made on the executors; their indices (a few hundred a document) come to the
    driver, which counts, fits the SVM, and calibrates its margins by a logistic curve on margins
    that two half models gave each other's rows. With labels of one class only, every document
    scores the share of label 1 (0.5 without labels).
    """
    train = common.training_rows(docs, labels, "quality", max_documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("found", pa.binary())])
        for ids, texts, ys in common.rows(batches, "doc_id", "text", "y"):
            yield common.batch(schema, [ids, ys, [indicators(t, bits).astype("<u4").tobytes() for t in texts]])

    got = sorted(common.arrow_map(train, run, "doc_id bigint, y int, found binary").collect())
    y = np.array([r.y for r in got], float)
    rows = [np.frombuffer(r.found, "<u4").astype(np.int64) for r in got]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return QualityModel(np.zeros(1 << bits), bits, 0.0, 6.0 if share == 1 else -6.0 if share == 0 else 0.0)
    half = np.arange(len(y)) % 2
    margins = np.zeros(len(y))
    for h in (0, 1):
        w = _train([r for r, k in zip(rows, half, strict=True) if k != h], y[half != h], bits, alpha, c)
        for i in np.flatnonzero(half == h):
            margins[i] = w[rows[i]].sum() / np.sqrt(len(rows[i]))
    slope, bias = common.logistic(margins[:, None], y, ridge=1e-5)
    return QualityModel(_train(rows, y, bits, alpha, c), bits, float(slope), float(bias))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (the probability of label 1) of every row.

    Null texts score as empty ones; whole texts of any length are read (at about 100 bytes a
    character); repeated rows, and texts with the same indicators, score alike; an empty table gives
    no row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for ids, texts in common.rows(batches, "doc_id", "text"):
            z = np.array([m.margin(t or "") for t in texts])
            yield common.batch(schema, [ids, common.sigmoid(m.slope * z + m.bias).tolist()])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, score double")
