"""Embedders: what turns texts into unit vectors."""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w{2,}")


class Embedder(Protocol):
    dims: int
    model: str

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay as they are."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def hashed(texts: list[str], dims: int) -> np.ndarray:
    """Signed feature hashing: a word adds 1 or -1 at a place, both of its SHA-256. A batch at once, so
    each distinct word is hashed once."""
    words = [WORD.findall(t.lower()) for t in texts]
    place: dict[str, tuple[int, float]] = {}
    for w in {w for ws in words for w in ws}:
        d = hashlib.sha256(w.encode()).hexdigest()
        place[w] = int(d[:8], 16) % dims, 1.0 if int(d[8], 16) < 8 else -1.0
    out = np.zeros((len(texts), dims))
    found = [place[w] for ws in words for w in ws]
    if found:
        at, sign = (np.array(x) for x in zip(*found, strict=True))
        np.add.at(out, (np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), at), sign)
    return unit(out)


class HashingEmbedder:
    """Feature hashing: deterministic, and needs no model. Texts go through Arrow in batches."""

    model = "hashing"

    def __init__(self, dims: int = 384):
        self.dims = dims

    def column(self, text: Column) -> Column:
        dims = self.dims

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(hashed(s.fillna("").tolist(), dims).astype(np.float32)))

        return embed(text)

    def query(self, text: str) -> list[float]:
        return hashed([text], self.dims)[0].tolist()


def model_name(name: str) -> str:
    """A model's full name: short ones belong to the default organisation."""
    return name if "/" in name else f"sentence-transformers/{name}"


class ModelEmbedder:
    """A model behind Arrow batches. ``load`` is called with the model's full name, once in each Python
    worker (and once in the driver, for queries), and gives a function of texts to vectors."""

    def __init__(self, name: str, dims: int, load: Callable[[str], Callable[[list[str]], np.ndarray]]):
        self.model, self.dims, self.load = model_name(name), dims, load
        self._own: Callable[[list[str]], np.ndarray] | None = None

    def column(self, text: Column) -> Column:
        name, load = self.model, self.load

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = load(name)
            for s in batches:
                made = unit(np.asarray(run(s.fillna("").tolist()), float)) if len(s) else np.zeros((0, 1))
                yield pd.Series(list(made.astype(np.float32)))

        return embed(text)

    def query(self, text: str) -> list[float]:
        if self._own is None:
            self._own = self.load(self.model)
        return unit(np.asarray(self._own([text]), float))[0].tolist()


class QueryCache:
    """Least-recently-used query vectors that also expire; off if either bound is 0 or less."""

    def __init__(self, embedder: Embedder, most: int = 10_000, ttl: float = 3600, clock=time.monotonic):
        self.embedder, self.most, self.ttl, self.clock = embedder, most, ttl, clock
        self.held: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def query(self, text: str) -> list[float]:
        if self.most <= 0 or self.ttl <= 0:
            return self.embedder.query(text)
        key = hashlib.sha256(f"{self.embedder.model}:{text}".encode()).hexdigest()
        found = self.held.get(key)
        if found and self.clock() - found[0] <= self.ttl:
            self.held.move_to_end(key)
            self.hits += 1
            return found[1]
        self.misses += 1
        vector = self.embedder.query(text)
        self.held[key] = (self.clock(), vector)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
            self.evictions += 1
        return vector

    def clear(self) -> None:
        self.held.clear()

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "size": len(self.held)}
