"""Toxicity (operator 1): maximum-scoring segments over word log-odds, calibrated by extreme values."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ASCII_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of a stem; its key in the counts is the stem after a byte that no word has.
STEM, _MARK = 4, b" "
_BLANK = bytes.maketrans(_ASCII_PUNCTUATION, b" " * len(_ASCII_PUNCTUATION))


def words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return common.to_bytes(text.lower()).translate(_BLANK).split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), disjoint, in linear time (Ruzzo and Tompa).

    Only the positive scores are walked: what lies between two of them enters through prefix sums.
    Each candidate holds its left and right cumulative sums; a new candidate merges with those on
    the stack as long as an earlier left sum is less than its own and the right sum there is too.
    """
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list[float]] = []  # begin, end, left sum, right sum, index of the nearest candidate with a lesser left sum
    for i in hits.tolist():
        begin, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([begin, end, left, right, j])
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(b), int(e), r - l) for b, e, l, r, _ in stack]


def half_of(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


@dataclass(frozen=True)
class SegmentModel:
    """Word scores and what turns segments into a probability.

    A word without a score of its own takes that of its first ``STEM`` bytes, if there is one.
    """

    scores: dict[bytes, float]
    stems: dict[bytes, float]
    drift: float
    rate: float  # lambda: the positive root of E[exp(lambda s)] = 1 over clean words
    location: float  # log K of the Gumbel law of the largest segment of clean documents
    weights: tuple[float, ...] = ()

    def segments(self, text: str) -> tuple[list[bytes], list[tuple[int, int, float]]]:
        w = words(text)
        own, stem = self.scores, self.stems.get
        s = np.array([own[x] if x in own else stem(x[:STEM], 0.0) for x in w], float) - self.drift
        return w, maximal_segments(s)

    def features(self, text: str) -> np.ndarray:
        """Extreme-value surprise of the largest segment, sum over significant ones, their number."""
        w, found = self.segments(text)
        normed = self.rate * np.array([s for *_, s in found]) - self.location - np.log(max(len(w), 1))
        best = float(normed.max()) if len(normed) else -3.0
        # -log P(max >= best) for a Gumbel law, and the same summed over segments that pass alone
        surprise = -np.log(-np.expm1(-np.exp(-np.clip(best, -20, 30))))
        significant = normed[normed > 0]
        return np.array([surprise, np.log1p(significant.sum()), np.log1p(len(significant))])

    def score(self, text: str) -> float:
        return float(common.sigmoid(self.features(text) @ np.array(self.weights[:-1]) + self.weights[-1]))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages as (first word, word after the last, normed score)."""
        w, found = self.segments(text)
        base = self.location + np.log(max(len(w), 1))
        return [(b, e, self.rate * s - base) for b, e, s in found if self.rate * s > base]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of words under an informative Dirichlet prior, and their z values.

    The prior of a word is its share of both classes together, with a weight of ``strength`` times
    the class's size, so a word that occurs in proportion scores 0.
    """
    share = (toxic + clean) / max(n_toxic + n_clean, 1)
    a, b = strength * n_toxic * share + 1e-9, strength * n_clean * share + 1e-9
    t, c = toxic + a, clean + b
    delta = np.log(t / ((1 + strength) * n_toxic - t + 1e-9)) - np.log(c / ((1 + strength) * n_clean - c + 1e-9))
    return delta, delta / np.sqrt(1 / t + 1 / c)


def _karlin_rate(values: np.ndarray, probabilities: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda v) = 1, by bisection (mean < 0 < max); 1 if no
    value is positive or the mean isn't negative."""
    values, p = values[probabilities > 0], probabilities[probabilities > 0]
    if values.max(initial=-1) <= 0 or float(p @ values) >= 0:
        return 1.0
    logs = np.log(p)
    low, high = 0.0, 1.0
    while np.logaddexp.reduce(logs + high * values) < 0 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.logaddexp.reduce(logs + mid * values) < 0 else (low, mid)
    return high


def _model(vocabulary: list[bytes], toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float], strength: float, z: float, drift: float) -> SegmentModel:
    delta, sure = log_odds(toxic, clean, *totals, strength)
    keep = np.abs(sure) >= z
    stem = np.array([w[:1] == _MARK for w in vocabulary], bool)
    stems = {w[1:]: float(d) for w, d, k, s in zip(vocabulary, delta, keep, stem, strict=True) if k and s}
    known = (toxic + clean >= 5) & ~stem  # known not to tell: its stem doesn't speak for it
    words_of = {w: float(d) if k else 0.0 for w, d, k, s, o in zip(vocabulary, delta, keep, stem, known, strict=True) if not s and (k or (o and w[:STEM] in stems))}
    keep, clean = keep & ~stem, np.where(stem, 0.0, clean)
    values = np.concatenate((np.where(keep, delta, 0.0) - drift, [-drift]))
    p = np.append(clean + 0.5 * keep, max(totals[1] - clean.sum(), 0.0))  # half a count for words clean rows lack
    rate = _karlin_rate(values, p / max(p.sum(), 1))
    return SegmentModel(words_of, stems, drift, rate, 0.0)


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = 20_000, max_words: int = 200_000, strength: float = 0.05, z: float = 3.0, drift: float = 0.05) -> SegmentModel:
    """Fit on about ``max_documents`` labelled rows outside the held-out fold.

    Words are counted on the executors, once a document (so a repeated line weighs no more than
    another), by class and by one of two halves of the documents; the
    ``max_words`` most telling of those in two documents at least come to the driver. Each half's
    documents are then scored by the other half's words, and those features calibrate the result:
    the Gumbel location from clean documents, then a logistic curve. Without labels of both
    classes every document scores the share of label 1 (0.5, if there is none).
    """
    train = common.materialize(common.training_rows(docs, labels, "toxic", max_documents), "toxic_train")
    word_schema = pa.schema([("word", pa.binary()), ("half", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for ids, texts, ys in common.rows(batches, "doc_id", "text", "y"):
            for doc_id, text, y in zip(ids, texts, ys, strict=True):
                found = set(words(text))
                for w in found | {_MARK + w[:STEM] for w in found}:
                    n[w, half_of(doc_id), y] += 1
        keys = list(n)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield common.batch(word_schema, [[k[0] for k in part], [k[1] for k in part], [k[2] for k in part], [n[k] for k in part]])

    counts = common.arrow_map(train, count, "word binary, half int, y int, n bigint")
    table = common.materialize(
        counts.groupBy("word").agg(*(F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1))),
        "toxic_words",
    )
    names = ["n00", "n01", "n10", "n11"]
    is_word = F.substring("word", 1, 1) != F.lit(_MARK)
    totals = [float(x or 0) for x in table.where(is_word).agg(*(F.sum(n) for n in names)).first()]
    n_clean, n_toxic = totals[0] + totals[2], totals[1] + totals[3]
    if not n_clean or not n_toxic:
        y = [r[0] for r in train.select("y").collect()]
        share = float(np.mean(y)) if y else 0.5
        odds = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not y else (6.0 if share else -6.0))
        return SegmentModel({}, {}, drift, 1.0, 0.0, (0.0, 0.0, 0.0, odds))
    expected = (F.col("n00") + F.col("n10")) / n_clean * n_toxic
    gap = F.abs(F.col("n01") + F.col("n11") - expected) / F.sqrt(expected + F.col("n01") + F.col("n11") + 1)
    told = table.where("n00 + n01 + n10 + n11 >= 2").orderBy(gap.desc(), "word").limit(max_words).select("word", *names).toPandas()
    vocabulary = [bytes(w) for w in told["word"]]
    n = {k: told[k].to_numpy(float) for k in names}
    halves = [_model(vocabulary, n[f"n{h}1"], n[f"n{h}0"], (totals[2 * h + 1], totals[2 * h]), strength, z, drift) if totals[2 * h] and totals[2 * h + 1] else SegmentModel({}, {}, drift, 1.0, 0.0) for h in (0, 1)]
    whole = _model(vocabulary, n["n01"] + n["n11"], n["n00"] + n["n10"], (n_toxic, n_clean), strength, z, drift)
    told = _by_other_half(train, halves, lambda m, text: _largest(m, text))
    y, size, top = told[:, 0], np.log(np.maximum(told[:, 1], 1)), told[:, 2]
    # P(max < x) = exp(-K n exp(-x)): the maximum-likelihood K over clean documents, capped below by the empty ones
    clean = y == 0
    excess = np.exp(-np.clip(top[clean], 0, 50) + size[clean])
    location = float(np.log(max(clean.sum(), 1)) - np.log(max(excess.sum(), 1e-9))) if clean.any() else 0.0
    placed = _by_other_half(train, [replace(m, location=location) for m in halves], lambda m, text: m.features(text))
    weights = common.logistic(placed[:, 1:], placed[:, 0])
    return replace(whole, location=location, weights=tuple(weights))


def _largest(model: SegmentModel, text: str) -> np.ndarray:
    """Words of a text and the normed score of its largest segment."""
    w, found = model.segments(text)
    return np.array([len(w), max((model.rate * s for *_, s in found), default=-np.inf)])


def _by_other_half(train: DataFrame, halves: list[SegmentModel], measure: Callable[[SegmentModel, str], np.ndarray]) -> np.ndarray:
    """(label, measures) of each training row, by the model of the half that it isn't in; a few
    numbers of about ``max_documents`` rows, in the order of the rows' ids and texts' measures."""
    shared = train.sparkSession.sparkContext.broadcast(halves)
    schema = pa.schema([("found", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, ys in common.rows(batches, "doc_id", "text", "y"):
            yield common.batch(schema, [[[float(y), *measure(shared.value[1 - half_of(i)], t)] for i, t, y in zip(ids, texts, ys, strict=True)]])

    rows = [r.found for r in common.arrow_map(train, run, "found array<double>").collect()]
    return np.array(sorted(rows))


def score(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """doc_id, score, and the significant passages (word offsets and normed scores) of every row.

    Null and empty texts have no passage and get the score of that; whole texts are read, whatever
    their length; repeated rows score alike; an empty table gives no row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, bias = np.array(m.weights[:-1]), m.weights[-1]
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        for ids, texts in common.rows(batches, "doc_id", "text"):
            x, spans = [], []
            for text in texts:
                x.append(m.features(text or ""))
                spans.append([{"begin": b, "end": e, "score": s} for b, e, s in m.spans(text or "")] if x[-1][2] else [])
            yield common.batch(schema, [ids, common.sigmoid(np.array(x) @ weights + bias).tolist(), spans])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, score double, passages array<struct<begin:int,end:int,score:double>>")


def reject(docs: DataFrame, model: SegmentModel, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, bias = np.array(m.weights[:-1]), m.weights[-1]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = np.array([m.features(t or "") for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                yield part.filter(pa.array(common.sigmoid(x @ weights + bias) < threshold))

    return common.arrow_map(docs, run, docs.schema)
