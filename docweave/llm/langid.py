"""Language ID (operator 6): each document as a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15


def grams(text: str) -> np.ndarray:
    """Hashed 2- and 4-grams of the lower-cased text's UTF-8 bytes, runs of non-letters made one space."""
    raw = np.frombuffer(common.to_bytes(text.lower()), np.uint8)
    letter = ((raw >= 97) & (raw < 123)) | (raw >= 128)
    raw = np.where(letter, raw, 32).astype(np.uint32)
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]] if len(raw) else raw
    raw = np.r_[np.uint32(32), raw, np.uint32(32)]
    two = raw[:-1] | raw[1:] << np.uint32(8)
    out = [two * np.uint32(0x9E3779B1)]
    if len(raw) > 3:
        four = two[:-2] | two[2:] << np.uint32(16)
        out.append((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(1))
    h = np.concatenate(out)
    return (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class MixtureModel:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # (2 ** BITS, languages)
    penalty: float = 0.5

    def _em(self, p: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        """Shares that maximise the likelihood of counts ``n`` of grams with ``p``, and its log."""
        share, total, weights = np.full(p.shape[1], 1 / p.shape[1]), n.sum(), n[:, None] * p
        for _ in range(steps if p.shape[1] > 1 else 0):
            new = share * ((1 / (p @ share)) @ weights) / total
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-3:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None, steps: int = 30) -> dict[str, float]:
        """Proportions of the languages of a text; empty if it has no letter.

        From all languages, those whose removal costs no more log-likelihood than the penalty
        (``penalty`` times the log of the number of grams, for each share) go, smallest share first.
        """
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return {}
        found, n = np.unique(grams(text), return_counts=True)
        p, n = self.likelihood[found], n.astype(float)
        price = self.penalty * np.log(n.sum() + 1)
        active = np.arange(p.shape[1])
        share, best = self._em(p, n, steps)
        few = len(active) // 2
        while few:
            # of equal shares the later name goes; several at once, where together they cost less than one may
            left = np.sort(np.lexsort((-active, share))[few:])
            fewer, value = self._em(p[:, active[left]], n, steps)
            if best - value <= price:
                active, share, best = active[left], fewer, value
                few = min(few, len(active) - 1)
            else:
                few //= 2
        return {self.languages[i]: float(s) for i, s in zip(active, share / share.sum(), strict=True)}

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        mixture = self.infer(text)
        if not mixture:
            return "und", 0.0, {}
        top = max(sorted(mixture), key=mixture.get)
        return top, min(1.0, mixture[top]), mixture


def fit(docs: DataFrame, *, max_documents: int = 20_000, smoothing: float = 0.5, penalty: float = 0.5) -> MixtureModel:
    """Gram counts by language of about ``max_documents`` rows with a language outside the held-out fold,
    some of each language.

    Each task sends one array of counts a language; documents enter with at most 4,000 grams'
    weight each, so that a long one doesn't speak for its language alone.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").where(F.col("lang").isNotNull() & (common.fold_of(F.col("doc_id")) != 0))
    train = common.stratified(text, F.col("doc_id"), "lang", max_documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for texts, langs in common.rows(batches, "text", "lang"):
            for t, lang in zip(texts, langs, strict=True):
                h = grams(t)
                sums.setdefault(lang, np.zeros(1 << BITS))
                sums[lang] += np.bincount(h, minlength=1 << BITS) * min(1.0, 4000 / max(len(h), 1))
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s.astype("<f8").tobytes()], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, "<f8") for x in table.column("counts").to_pylist()), np.zeros(1 << BITS))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = common.arrow_map(train, count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    sums.sort(key=lambda r: r.lang)
    if not sums:
        return MixtureModel((), np.zeros((1 << BITS, 0)), penalty)
    counts = np.column_stack([np.frombuffer(r.counts, "<f8") for r in sums])
    backing = counts.sum(axis=1, keepdims=True) + 1
    counts = counts + smoothing * len(counts) / 64 * backing / backing.sum()
    return MixtureModel(tuple(r.lang for r in sums), counts / counts.sum(axis=0), penalty)


def identify(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """doc_id, lang_pred, score and the mixture of every row.

    ``und`` with score 0 for null texts and texts without a letter. Whole texts are read, of any
    length (at about 40 bytes a character); ties go to the smaller name; repeated rows get the same;
    an empty table gives no row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in common.rows(batches, "doc_id", "text"):
            made = [m.predict(t) for t in texts]
            yield common.batch(schema, [ids, [x[0] for x in made], [x[1] for x in made], [list(x[2].items()) for x in made]])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double, mixture map<string,double>")
