"""The composite search over an index: lists per corpus, floor, fusion, merge, shaping."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import ranking as R
from ..operators import sections as S

MOST_CHARS = 10_000
MODES = ("chunks", "documents", "auto")
#: Query words that go into the plan as a filter, which prunes postings when they are read.
MOST_WORDS = 2_000
#: Hits that come to the driver and back as a table of the plan, so that what follows is small.
MOST_HITS = 10_000
#: (id, text, vector) of each query.
Asked = list[tuple[str, str, list[float]]]


@dataclass(frozen=True)
class Request:
    query: str
    top_k: int = 5
    corpora: list[str] | None = None
    hybrid: bool | None = None
    return_mode: str = "chunks"
    max_chars: int | None = None
    section_mode: bool = False
    section_filter: str | None = None
    dedup_sections: bool = False
    max_distance: float | None = None


@dataclass(frozen=True)
class Index:
    """The tables of a snapshot, of live files only."""

    corpora: DataFrame  # corpus, topic, weight, max_distance, corpus_ord
    chunks: DataFrame
    documents: DataFrame
    postings: DataFrame
    terms: DataFrame  # corpus, term, df
    stats: DataFrame  # corpus, n, avgdl
    metric: str = "ip"


@dataclass
class Lists:
    dense: DataFrame
    sparse: DataFrame | None
    dropped: DataFrame  # what the floor took off the dense list


def error(message: str, query: str = "", **more: Any) -> dict[str, Any]:
    return {"results": [], "total": 0, "query": query, "error": message} | more


def check(r: Request, config: Config) -> dict[str, Any] | None:
    """The first thing wrong with a request, in the contract's order."""
    if r.top_k < 1:
        return error("top_k must be >= 1", r.query)
    if not r.query or not r.query.strip():
        return error("query required", r.query)
    if len(r.query) > MOST_CHARS:
        return error(f"Query too long ({len(r.query)} chars, max {MOST_CHARS})", r.query[:100] + "...")
    if r.return_mode not in MODES:
        return error(f"Invalid return_mode: {r.return_mode!r}. Must be 'chunks', 'documents', or 'auto'.", r.query)
    known = {c.name for c in config.corpora}
    for name in r.corpora or []:
        if name not in known:
            return error(f"corpus not found: {name}", r.query)
    return None


def require_cosine(index: Index) -> None:
    if index.metric != "ip":
        raise RuntimeError("a relevance floor needs an inner product index of unit vectors")


def chunk_hits(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("ord", F.struct("source_path", "pos"))


def sparse_scores(index: Index, asked: Asked, chosen: Column) -> DataFrame:
    """BM25 of the stored postings: only those of the queries' words are read, with the stored
    frequencies and lengths, which count chunks without a word as well."""
    spark = index.chunks.sparkSession
    terms = R.query_terms(spark.createDataFrame([(q, t) for q, t, _ in asked], "query_id string, query string")).collect()
    words = sorted({t.term for t in terms})
    posts, df = index.postings.where(chosen), index.terms.where(chosen)
    if len(words) <= MOST_WORDS:
        posts, df = (x.where(F.col("term").isin(*words)) for x in (posts, df))
    small = spark.createDataFrame([tuple(t) for t in terms], "query_id string, term string, qtf bigint")
    return R.bm25_scores(posts, index.stats.where(chosen), small, df, n_terms=len(terms))


def brought(*frames: DataFrame) -> list[DataFrame]:
    """Small frames, evaluated side by side, as tables of the plan."""
    with ThreadPoolExecutor(len(frames)) as pool:
        tables = list(pool.map(lambda df: df.toArrow(), frames))
    return [df.sparkSession.createDataFrame(t, df.schema) for df, t in zip(frames, tables, strict=True)]


def floor_of(corpus: str, config: Config, r: Request) -> float | None:
    own = next(c.max_distance for c in config.corpora if c.name == corpus)
    return next((x for x in (own, r.max_distance, config.search.max_distance) if x is not None), None)


def lists(index: Index, asked: Asked, names: list[str], config: Config, r: Request, m: int, hybrid: bool, scoped: DataFrame | None = None) -> Lists:
    """Each corpus's best ``m`` by vector, less what the floor drops, and by BM25. ``scoped``
    (query_id, corpus) says which corpora a query asks, if not all of ``names``."""
    chosen = F.col("corpus").isin(*names)

    def best(hits: DataFrame) -> DataFrame:
        own = hits if scoped is None else hits.join(F.broadcast(scoped), ["query_id", "corpus"], "left_semi")
        return R.top_per_corpus(own, m)

    vectors = chunk_hits(index.chunks.where(chosen & F.col("embedding").isNotNull())).select("corpus", "chunk_id", "ord", "embedding")
    dense = best(R.dense_scores(vectors, [(q, v) for q, _, v in asked], m))
    sparse = best(sparse_scores(index, asked, chosen)) if hybrid else None
    if len(asked) * len(names) * m <= MOST_HITS:
        dense, *rest = brought(dense, *([sparse] if hybrid else []))
        sparse = rest[0] if hybrid else None
    floors = R.effective_floor(index.corpora.where(chosen), r.max_distance, config.search.max_distance)
    marked = R.apply_floor(dense, floors)
    dense = R.top_per_corpus(marked.where("kept").drop("kept", "rank"), m)
    return Lists(dense, sparse, marked.where("not kept"))


def ranked(index: Index, asked: Asked, scoped: list[tuple[str, str]], config: Config, r: Request, hybrid: bool) -> DataFrame:
    """Hits of many queries at once, each in its own corpora, by ``place``."""
    scope = index.chunks.sparkSession.createDataFrame(scoped, "query_id string, corpus string")
    m = 2 * r.top_k
    found = lists(index, asked, sorted({c for _, c in scoped}), config, r, m, hybrid, scope)
    return R.merge(_merged(found, index, config, m), index.corpora, None)


def _merged(found: Lists, index: Index, config: Config, m: int) -> DataFrame:
    if found.sparse is not None:
        return R.top_per_corpus(R.fuse(found.dense, found.sparse, fusion_of(config)), m, "score").drop("rank")
    return R.weighted(found.dense.drop("rank"), index.corpora)


def fusion_of(config: Config) -> R.Fusion:
    s = config.search
    return R.Fusion(s.fusion_alpha, s.rrf_k, s.dense_weight, s.bm25_weight)


def described(hits: DataFrame, index: Index, *, parity: bool = True) -> DataFrame:
    """Hits with their chunk's columns. Hits of the sparse list alone have neither distance nor
    section, unless ``parity`` is off."""
    c = index.chunks.select("corpus", "chunk_id", "source_path", "heading", "text", "summary", "heading_path", "section_id", "char_offset", "pos")
    out = hits.join(c, ["corpus", "chunk_id"])
    raw = F.col("dense_score") if "dense_score" in hits.columns else F.col("raw_score")
    out = out.withColumn("distance", F.round(1 - raw, R.DIGITS))
    if parity:
        for name in ("heading_path", "section_id"):
            out = out.withColumn(name, F.when(raw.isNotNull(), F.col(name)))
    return out.withColumn("location", X.location(F.col("source_path"), F.col("heading"))).withColumn("filename", X.filename(F.col("source_path")))


def _rows(df: DataFrame, columns: list[str]) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.orderBy("place").select(*columns).collect()]


def search(index: Index, config: Config, r: Request, vector: list[float]) -> dict[str, Any]:
    """Answer one request; only its k rows come to the driver."""
    if wrong := check(r, config):
        return wrong
    names = r.corpora or [c.name for c in config.corpora]
    hybrid = config.search.hybrid if r.hybrid is None else r.hybrid
    weights = index.corpora
    floor = {n: x for n in names if (x := floor_of(n, config, r)) is not None}
    if floor:
        require_cosine(index)
    if r.section_filter:
        return _nothing(index, r, names) or _search_sections(index, config, r, vector, names, hybrid)
    m = 2 * r.top_k
    found = lists(index, [("q", r.query, vector)], names, config, r, m, hybrid)
    hits = R.merge(_merged(found, index, config, m), weights, None).drop("place", "corpus_ord")
    read = index
    if m * len(names) <= MOST_HITS:  # then only the chunks of these hits are read
        (hits,) = brought(hits)
        ids = [x.chunk_id for x in hits.select("chunk_id").collect()]
        if not ids and (wrong := _nothing(index, r, names)):
            return wrong
        read = replace(index, chunks=index.chunks.where(F.col("chunk_id").isin(ids)))
    hits = described(hits, read)
    if config.search.toc_rerank:
        hits = R.rerank_by_headings(hits, F.lit(r.query), config.search.toc_rerank_weight)
    hits = R.merge(hits, weights, None)
    if r.dedup_sections:
        hits = R.merge(R.dedup_sections(hits).drop("place", "corpus_ord"), weights, None)
    hits = hits.where(F.col("place") <= r.top_k).withColumn("chunk_id", X.public_id(F.col("corpus"), F.col("chunk_id")))
    floor_keys = {"max_distance_applied": floor, "filtered_by_distance": found.dropped.count()} if floor else {}
    if m * len(names) <= MOST_HITS:
        (hits,) = brought(hits)
    if floor and not hits.take(1):
        return {"results": [], "total": 0, "query": r.query} | floor_keys
    if r.section_mode:
        out = S.aggregate_sections(hits, index.chunks)
        rows = _rows(out, ["section_id", "heading", "heading_path", "text", "chunk_count", "corpus", "location", "source_path", "filename", "score", "summary"])
        return {"results": rows, "total": len(rows), "query": r.query, "hybrid": hybrid, "return_mode": "sections"}
    mode = r.return_mode
    if mode == "auto":
        size = S.estimated_size(hits).first()
        mode = "chunks" if (size.chars if size else 0) < (r.max_chars or config.search.max_chars) else "documents"
    if mode == "documents":
        rows = _rows(S.collapse_to_documents(hits, index.documents), ["source_path", "filename", "corpus", "score", "text", "char_count", "matched_chunks"])
    else:
        raw = F.col("dense_score") if "dense_score" in hits.columns else F.col("raw_score")
        hits = hits.withColumn("similarity", raw)
        rows = _rows(hits, ["chunk_id", "summary", "location", "source_path", "filename", "corpus", "score", F.col("similarity").alias("raw_score"), "distance", "heading_path", "section_id"])
    return {"results": rows, "total": len(rows), "query": r.query, "hybrid": hybrid, "return_mode": mode} | floor_keys


def _nothing(index: Index, r: Request, names: list[str]) -> dict[str, Any] | None:
    if index.chunks.where(F.col("corpus").isin(*names)).take(1):
        return None
    return error("No indexed content found. Index a corpus first.", r.query)


def _search_sections(index: Index, config: Config, r: Request, vector: list[float], names: list[str], hybrid: bool) -> dict[str, Any]:
    """Search inside the sections a filter selects: all their vectors, and the sparse list's hits in
    them; without any of those, the weighted vector scores alone."""
    chosen = F.col("corpus").isin(*names)
    chunks = index.chunks.where(chosen)
    wanted = S.sections_for_dense(chunks, r.section_filter)
    inside = chunks.join(wanted, ["corpus", "section_id"], "left_semi")
    wide = S.sections_for_sparse(chunks, r.section_filter) if hybrid else wanted
    if not wanted.take(1) and not wide.take(1):
        return error(f"section not found: {r.section_filter}", r.query)
    narrowed, asked = replace(index, chunks=inside), [("q", r.query, vector)]
    found = lists(narrowed, asked, names, config, r, r.top_k, False)
    hits = R.weighted(found.dense.drop("rank"), index.corpora).withColumn("dense_score", F.col("raw_score"))
    if hybrid:
        sparse = R.top_per_corpus(sparse_scores(index, asked, chosen), 3 * r.top_k).drop("rank")
        ids = chunks.join(wide, ["corpus", "section_id"], "left_semi").select("corpus", "chunk_id")
        sparse = R.top_per_corpus(sparse.join(ids, ["corpus", "chunk_id"], "left_semi"), 3 * r.top_k)
        fused = R.top_per_corpus(R.fuse(found.dense, sparse, fusion_of(config)), r.top_k, "score").drop("rank")
        matched = sparse.select("corpus").distinct()
        alone = hits.join(matched, "corpus", "left_anti").select(*fused.columns)
        hits = fused.join(matched, "corpus", "left_semi").unionByName(alone)
    hits = R.merge(hits, index.corpora, r.top_k)
    place = hits.select("corpus", "chunk_id", "place")
    hits = described(hits.drop("corpus_ord", "place"), index).join(place, ["corpus", "chunk_id"])
    hits = hits.withColumn("chunk_id", X.public_id(F.col("corpus"), F.col("chunk_id")))
    rows = _rows(hits, ["chunk_id", "summary", "location", "source_path", "filename", "corpus", "score", "distance", "heading_path", "section_id"])
    return {"results": rows, "total": len(rows), "query": r.query, "hybrid": hybrid, "section_filter": r.section_filter}
