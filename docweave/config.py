"""Settings: dataclasses, YAML or dict loading, type checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any

from .operators.chunking import Chunking

# Fixed defaults of the data model.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv")
UPLOADABLE = (".md", ".txt", ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".html", ".htm", ".csv", ".json")


def _number(x: Any, name: str, least: float | None = 0) -> float | None:
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)) or (least is not None and x < least):
        raise ValueError(f"{name} must be a number of at least {least}, not {x!r}")
    return float(x)


def _whole(x: Any, name: str, least: int) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {x!r}")
    return x


@dataclass
class Corpus:
    name: str
    path: str
    topic: str = ""
    weight: float = 1.0
    extensions: list[str] = field(default_factory=lambda: [".md", ".txt"])
    max_distance: float | None = None

    def __post_init__(self) -> None:
        self.extensions = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in self.extensions]
        if isinstance(self.weight, bool) or not isinstance(self.weight, (int, float)):
            self.weight = 1.0
        self.max_distance = _number(self.max_distance, f"corpora[{self.name}].max_distance")


@dataclass
class Search:
    hybrid: bool = True
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    rrf_k: int = 60
    max_chars: int = 8000
    toc_rerank: bool = False
    toc_rerank_weight: float = 0.3
    fusion_alpha: float = 0.3
    max_distance: float | None = None

    def __post_init__(self) -> None:
        self.dense_weight = _number(self.dense_weight, "search.dense_weight")
        self.bm25_weight = _number(self.bm25_weight, "search.bm25_weight")
        self.rrf_k = _whole(self.rrf_k, "search.rrf_k", 1)
        self.max_chars = _whole(self.max_chars, "search.max_chars", 1)
        self.max_distance = _number(self.max_distance, "search.max_distance")


@dataclass
class Embedding:
    model: str = "hashing"
    dimensions: int = 384
    preprocess: bool = True
    cache_max_size: int = 10_000
    cache_ttl: int = 3600


@dataclass
class Indexing:
    data_dir: str = "docweave-index"
    incremental: bool = True
    max_file_size: int = 52_428_800
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED))


@dataclass
class Upload:
    allow: list[str] = field(default_factory=list)
    max_file_size: int = 52_428_800
    allowed_extensions: list[str] = field(default_factory=lambda: list(UPLOADABLE))
    auto_index: bool = True


@dataclass
class Config:
    corpora: list[Corpus] = field(default_factory=list)
    search: Search = field(default_factory=Search)
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    indexing: Indexing = field(default_factory=Indexing)
    upload: Upload = field(default_factory=Upload)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        """From parsed YAML. A file without ``search.hybrid`` means false, unlike the dataclass."""

        def made(kind: type, values: dict[str, Any] | None, name: str) -> Any:
            values = values or {}
            if not isinstance(values, dict):
                raise ValueError(f"{name} must be a mapping")
            known = {f.name for f in fields(kind)}
            return kind(**{k: v for k, v in values.items() if k in known})

        chunking = raw.get("chunking") or {}
        _whole(chunking.get("max_size", 2000), "chunking.max_size", 1)
        _whole(chunking.get("overlap", 200), "chunking.overlap", 0)
        return cls(
            corpora=[made(Corpus, c, "corpora") for c in raw.get("corpora") or []],
            search=made(Search, {"hybrid": False} | (raw.get("search") or {}), "search"),
            embedding=made(Embedding, raw.get("embedding"), "embedding"),
            chunking=made(Chunking, chunking, "chunking"),
            indexing=made(Indexing, raw.get("indexing"), "indexing"),
            upload=made(Upload, raw.get("upload"), "upload"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, "rb") as f:
            return cls.from_dict(yaml.safe_load(decoded(f.read())) or {})

    def validate(self) -> list[str]:
        """Warnings: corpora with the same name, paths that are missing."""
        seen: set[str] = set()
        out = []
        for c in self.corpora:
            if c.name in seen:
                out.append(f"duplicate corpus name: {c.name}")
            seen.add(c.name)
            if "://" not in c.path and not os.path.exists(c.path):
                out.append(f"path does not exist: {c.path}")
        return out

    def effective_rows(self) -> list[tuple]:
        return [(c.name, c.topic, float(c.weight), c.max_distance, i) for i, c in enumerate(self.corpora)]


def decoded(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252; else an error that names the place."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        try:
            return raw.decode("cp1252")
        except UnicodeDecodeError as e:
            raise ValueError(f"config is neither UTF-8 nor cp1252: byte {e.start}, line {raw[: e.start].count(10) + 1}") from e
