"""The engine: indexing runs and the tool-level operations over a store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from difflib import get_close_matches
from inspect import signature
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import ingest as I
from ..operators import ranking as R
from ..operators import sections as S
from ..operators.chunking import chunk_documents
from ..sources import uploads
from ..sources.convert import TEXT, convert_files, pdf_markdown
from ..sources.files import scan_all
from ..sources.storage import TABLES, LockedError, Store, recent
from . import search as Q
from .embed import Embedder, HashingEmbedder, QueryCache

CORPORA = "corpus string, topic string, weight double, max_distance double, corpus_ord int"
KEY = ["corpus", "source_path"]
#: Files that may go without a plan that knows them by a table.
FEW = 1000
SEARCH = ("query", "top_k", "corpora", "hybrid", "return_mode", "max_chars", "section_mode", "section_filter", "dedup_sections", "max_distance")


class Engine:
    """``plugins`` convert formats by suffix; ``spans`` gives the text spans of a PDF's bytes, of which
    headings are found by their font sizes, with a ``.pdf`` plug-in for files where that fails."""

    def __init__(
        self,
        spark: SparkSession,
        config: Config,
        *,
        embedder: Embedder | None = None,
        plugins: dict[str, Callable[[bytes], str]] | None = None,
        spans: Callable[[bytes], Iterable[tuple]] | None = None,
    ):
        self.spark, self.config, self.plugins, self.spans = spark, config, plugins, spans
        self.embedder = embedder or HashingEmbedder(config.embedding.dimensions)
        if embedder is None and config.embedding.model != self.embedder.model:
            raise ValueError(f"embedding.model {config.embedding.model!r} needs an embedder (ModelEmbedder) handed in")
        self.store = Store(spark, config.indexing.data_dir)
        self.cache = QueryCache(self.embedder, config.embedding.cache_max_size, config.embedding.cache_ttl)

    # -- write path ----------------------------------------------------------------------------

    def index(self, corpus: str = "all", force: bool = False) -> dict[str, Any] | list[dict[str, Any]]:
        """Bring the index up to the files: only changed ones are converted, their chunks replaced,
        deleted files' chunks removed. One plan for all corpora; errors are collected by file."""
        names = [c.name for c in self.config.corpora]
        if corpus != "all" and corpus not in names:
            return {"error": f"corpus not found: {corpus}"}
        chosen = [c for c in self.config.corpora if corpus in ("all", c.name)]
        began = time.time()
        try:
            with self.store.lock("index"):
                found = scan_all(self.spark, self.config, chosen)
                stats = self._index(found, [c.name for c in chosen], force, force or not self.config.indexing.incremental)
        except LockedError as e:
            return {"error": str(e).replace("corpus index", f"corpus {corpus}")}
        took = int((time.time() - began) * 1000)
        out = [stats.get(c.name, {"corpus": c.name, "files_indexed": 0, "files_skipped": 0, "chunks_created": 0, "errors": []}) | {"duration_ms": took} for c in chosen]
        return out if corpus == "all" else out[0]

    def upsert(self, files: DataFrame, corpora: list[str]) -> dict[str, dict[str, Any]]:
        """Index these files (columns of a scan) as they are, without taking others for deleted."""
        with self.store.lock("index"):
            return self._index(files, corpora, False, False, whole=False)

    def _index(self, found: DataFrame, names: list[str], fresh: bool, anew: bool, whole: bool = True) -> dict[str, dict[str, Any]]:
        """``fresh``: nothing of these corpora is kept, nor the caches. ``anew``: known files are
        converted again. ``whole``: known files that weren't found are gone. Content is read once, of
        all files, for its hash; what changed is kept from there on."""
        old = {t: self.store.read(t, names) for t in TABLES}
        if fresh:
            self.store.forget()
            self.cache.clear()
            old = {t: df.limit(0) for t, df in old.items()}
        todo = I.changed(found, old["files"], force=anew).persist()
        listed = found.select(*KEY)
        gone = I.deleted(listed, old["files"]).select(*KEY) if whole else old["files"].limit(0).select(*KEY)
        touched = {r.corpus for r in todo.select("corpus").union(gone.select("corpus")).distinct().collect()} | (set(names) if fresh else set())
        converted = self._converted(todo).persist()
        good, bad = converted.where("error is null"), converted.where("error is not null")
        chunks = good.limit(0)
        if touched:
            documents = good.select("corpus", "source_path", "filename", "markdown")
            chunks = self._embedded(chunk_documents(documents, self.config.chunking)).persist()
            files = good.select("corpus", "source_path", "file_hash", "file_size", "modified_at")
            self._commit(old, documents, chunks, files, good.select(*KEY).unionByName(gone).persist(), sorted(touched))
        rows = I.run_stats(listed, good, chunks, bad).collect()
        for df in (converted, chunks, todo):
            df.unpersist()
        return {r.corpus: r.asDict(recursive=True) for r in rows}

    def _commit(self, old: dict[str, DataFrame], documents: DataFrame, chunks: DataFrame, files: DataFrame, replaced: DataFrame, touched: list[str]) -> None:
        """A new version of the corpora with a changed file; the others' files stay as they are. Old rows
        of unchanged files are carried over, and only new chunks are cut into words."""
        mine = F.col("corpus").isin(*touched)
        own = {t: df.where(mine) for t, df in old.items()}
        texts = chunks.select("corpus", "chunk_id", F.struct("source_path", "pos").alias("ord"), "text")
        words = R.postings(texts)
        key = replaced.select(F.col("corpus").alias("rc"), F.col("source_path").alias("rp")).distinct()
        keep = own["postings"].join(key, (F.col("corpus") == F.col("rc")) & (F.col("ord.source_path") == F.col("rp")), "left_anti")
        postings = keep.unionByName(words.select(*keep.columns))
        lengths = texts.select("corpus", "chunk_id", "ord.source_path", F.size(X.tokens(F.col("text"))).cast("long").alias("dl"))
        lengths = I.upsert(own["lengths"], lengths, replaced)
        tables = {
            "files": I.upsert(own["files"], files, replaced),
            "documents": I.upsert(own["documents"], documents, replaced),
            "chunks": I.upsert(own["chunks"], chunks.select(*own["chunks"].columns), replaced),
            "postings": postings,
            "lengths": lengths,
            "terms": R.term_stats(postings),
            "stats": R.corpus_stats(lengths),
        }
        metric = getattr(self.embedder, "metric", "ip")
        self.store.commit(tables, touched, {"metric": metric, "model": self.embedder.model, "dimensions": self.embedder.dims})
        replaced.unpersist()

    def _converted(self, files: DataFrame) -> DataFrame:
        """Files with markdown or an error. What isn't plain text is taken from the conversion cache,
        where its content is known, and put there else."""
        ext = X.extension(F.col("source_path"))
        plain = convert_files(files.where(ext.isin(*TEXT)), self.plugins)
        binary = files.where(~ext.isin(*TEXT)).withColumn("ext", ext)
        if not binary.take(1):
            return plain
        keyed = ["file_hash", "ext"]
        cache = self.store.cached("converted").dropDuplicates(keyed)
        columns = [c for c in files.columns if c != "content"]
        known = binary.select(*columns, "ext").join(cache, keyed).select(*columns, "markdown", F.lit(None).cast("string").alias("error"))
        missing = binary.join(cache.select(*keyed), keyed, "left_anti")
        made = convert_files(missing.where("ext <> '.pdf'") if self.spans else missing, self.plugins)
        if self.spans:
            made = made.unionByName(self._pdf(missing.where("ext = '.pdf'")))
        made = made.persist()
        self.store.remember("converted", made.where("error is null").dropDuplicates(keyed))
        return plain.unionByName(known.select(*plain.columns)).unionByName(made.select(*plain.columns))

    def _pdf(self, files: DataFrame) -> DataFrame:
        by_size = pdf_markdown(files, self.spans).where("markdown is not null")
        kept = [c for c in files.columns if c != "content"]
        good = files.select(*kept).join(by_size, KEY).select(*kept, "markdown", F.lit(None).cast("string").alias("error"))
        rest = convert_files(files.join(by_size.select(*KEY), KEY, "left_anti").select(*files.columns), self.plugins)
        return good.unionByName(rest.select(*good.columns))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """Chunks with their vectors; a text that was embedded lately, or stands here twice, is embedded once."""
        how = self.config.embedding
        text = X.embedding_text(F.col("heading"), F.col("text")) if how.preprocess else F.col("text")
        if how.cache_max_size <= 0 or how.cache_ttl <= 0:
            return chunks.withColumn("embedding", self.embedder.column(text))
        keyed = chunks.withColumn("vector_text", text).withColumn("key", X.cache_key(f"{self.embedder.model}/{self.embedder.dims}", F.col("vector_text")))
        held = recent(self.store.cached("vectors"), how.cache_ttl).select("key")
        missing = I.cache_misses(keyed.select("key", "vector_text"), held, ["key"])
        self.store.remember("vectors", missing.select("key", self.embedder.column(F.col("vector_text")).alias("embedding"), F.current_timestamp().alias("ts")))
        vectors = self.store.cached("vectors").groupBy("key").agg(F.max_by("embedding", "ts").alias("embedding"))
        return keyed.join(vectors, "key", "left").drop("key", "vector_text")

    def upload(self, corpus: str, filename: str, content: str | bytes) -> dict[str, Any]:
        try:
            raw = uploads.decode(content) if isinstance(content, str) else content
        except ValueError as e:
            return {"error": str(e)}
        return self._reindexed(uploads.save(self.spark, self.config, corpus, filename, raw))

    def delete(self, corpus: str, filename: str) -> dict[str, Any]:
        return self._reindexed(uploads.delete(self.spark, self.config, corpus, filename))

    def _reindexed(self, out: dict[str, Any]) -> dict[str, Any]:
        if "error" not in out and self.config.upload.auto_index:
            out |= {"index": self.index(out["corpus"]), "indexed": True}
        return out

    # -- read path -----------------------------------------------------------------------------

    def corpora(self) -> DataFrame:
        return self.spark.createDataFrame(self.config.effective_rows(), CORPORA)

    def live(self, names: list[str]) -> DataFrame:
        """(corpus, source_path) of the files that are there now: a listing, no content."""
        return scan_all(self.spark, self.config, [c for c in self.config.corpora if c.name in names]).select(*KEY)

    def gone(self, names: list[str]) -> DataFrame | None:
        """Known files that aren't there any more; None if all are. A few become a table of the plan."""
        missing = I.deleted(self.live(names), self.store.read("files", names)).select(*KEY)
        rows = missing.take(FEW + 1)
        if not rows:
            return None
        return F.broadcast(self.spark.createDataFrame(rows, "corpus string, source_path string")) if len(rows) <= FEW else missing

    def snapshot(self, corpora: list[str] | None = None) -> Q.Index:
        """The tables of these corpora. Chunks and documents of files that vanished since the last index
        run are left out before any ranking; statistics of words stay those of the index."""
        names = corpora or [c.name for c in self.config.corpora]
        gone, read = self.gone(names), lambda t: self.store.read(t, names)
        chunks, documents, postings = read("chunks"), read("documents"), read("postings")
        if gone is not None:
            chunks, documents = (df.join(gone, KEY, "left_anti") for df in (chunks, documents))
            key = gone.select(F.col("corpus").alias("gc"), F.col("source_path").alias("gp"))
            postings = postings.join(key, (F.col("corpus") == F.col("gc")) & (F.col("ord.source_path") == F.col("gp")), "left_anti")
        metric = self.store.manifest()["properties"].get("metric", "ip")
        return Q.Index(self.corpora(), chunks, documents, postings, read("terms"), read("stats"), metric)

    def search(self, query: str, **options: Any) -> dict[str, Any]:
        r = Q.Request(query, **options)
        return Q.check(r, self.config) or Q.search(self.snapshot(r.corpora), self.config, r, self.cache.query(query))

    def evaluate(self, golden: list[dict[str, Any]], *, k: int = 5, modes: tuple[str, ...] = ("dense", "hybrid")) -> dict[str, dict[str, Any]]:
        """Recall, first-hit share and reciprocal rank of a golden set by mode: one plan a mode for all its queries."""
        index, frame, out = self.snapshot(), E.golden_frame(self.spark, golden), {}
        asked = [(str(i), g["query"], self.cache.query(g["query"])) for i, g in enumerate(golden)]
        known = [c.name for c in self.config.corpora]
        scoped = [(str(i), c) for i, g in enumerate(golden) for c in ([g["corpus"]] if isinstance(g["corpus"], str) else g["corpus"] or known)]
        for mode in modes:
            hits = Q.ranked(index, asked, scoped, self.config, Q.Request("", top_k=k), mode == "hybrid")
            hits = Q.described(hits.where(F.col("place") <= k).drop("corpus_ord"), index)
            found = hits.select("query_id", "place", E.match_keys(F.col("source_path"), F.col("location"), F.col("filename")).alias("keys"))
            out[mode] = E.metrics(E.first_hit_ranks(frame, found)).first().asDict()
        return out

    def get_chunk(self, chunk_id: str) -> dict[str, Any]:
        corpus, _, key = chunk_id.rpartition(":")
        rows = self.store.read("chunks", [corpus]).where(F.col("chunk_id") == key).drop("embedding").take(1) if corpus else []
        return rows[0].asDict(recursive=True) if rows else {"error": f"Chunk not found: {chunk_id}"}

    def get_document(self, corpus: str, source_path: str) -> dict[str, Any]:
        if corpus not in {c.name for c in self.config.corpora}:
            return {"error": f"corpus not found: {corpus}"}
        this = F.col("source_path") == source_path
        rows = self.store.read("documents", [corpus]).where(this).take(1)
        if not rows or not self.live([corpus]).where(this).take(1):
            return {"error": f"Document not found: {source_path} in corpus {corpus}"}
        n = self.store.read("chunks", [corpus]).where(this).count()
        return {"corpus": corpus, "source_path": source_path, "filename": rows[0].filename, "text": rows[0].markdown, "char_count": len(rows[0].markdown), "chunk_count": n}

    def list_documents(self, corpus: str | None = None) -> dict[str, Any]:
        if corpus is not None and corpus not in {c.name for c in self.config.corpora}:
            return {"error": f"corpus not found: {corpus}"}
        names = [corpus] if corpus else [c.name for c in self.config.corpora]
        files, chunks, gone = self.store.read("files", names), self.store.read("chunks", names), self.gone(names)
        if gone is not None:  # a vanished file is listed with size 0 until the next run
            files = files.join(gone.withColumn("gone", F.lit(True)), KEY, "left").withColumn("file_size", F.when(F.col("gone"), 0).otherwise(F.col("file_size"))).drop("gone")
        rows = I.list_documents(files, chunks.select(*KEY))
        at = self.store.indexed_at()
        return {"documents": [r.asDict() | {"last_indexed": at} for r in rows.orderBy("corpus", "source_path").collect()]}

    def status(self) -> list[dict[str, Any]]:
        rows = I.corpus_status(self.corpora(), self.store.read("chunks"), self.store.read("files"))
        floors = {r.corpus: r.floor for r in R.effective_floor(self.corpora(), None, self.config.search.max_distance).collect()}
        more = {"model": self.embedder.model, "dimensions": self.embedder.dims, "hybrid": self.config.search.hybrid}
        return [r.asDict() | {"max_distance": floors[r.corpus]} | more for r in rows.collect()]

    def get_toc(self, corpus: str, document: str | None = None) -> dict[str, Any]:
        """Trees of a corpus's documents; a document that is unknown has an unstructured stub."""
        if corpus not in {c.name for c in self.config.corpora}:
            return {"error": f"corpus not found: {corpus}"}
        chunks = self.store.read("chunks", [corpus])
        if document is not None:
            rows = S.toc(chunks.where(F.col("source_path") == document)).collect()
            if not rows:
                name = document.rsplit("/", 1)[-1]
                return {"title": name, "heading": name, "level": 0, "children": [], "chunk_count": 0, "structured": False}
            return rows[0].asDict(recursive=True)
        return {"corpus": corpus, "documents": [r.asDict(recursive=True) for r in S.toc_listing(S.toc(chunks)).orderBy("source_path").collect()]}

    def list_folders(self) -> dict[str, Any]:
        return uploads.list_folders(self.config)

    def download(self, corpus: str, filename: str) -> dict[str, Any]:
        """A file of a corpus as it is: its bytes and media type, or an error."""
        return uploads.fetch(self.spark, self.config, corpus, filename)

    # -- tool calls ----------------------------------------------------------------------------

    TOOLS = ("search", "get_chunk", "get_document", "list_documents", "index", "status", "list_folders", "upload", "get_toc", "delete")

    @classmethod
    def arguments(cls, tool: str) -> list[str]:
        return sorted(SEARCH) if tool == "search" else sorted(p for p in signature(getattr(cls, tool)).parameters if p != "self")

    def call(self, tool: str, arguments: dict[str, Any]) -> dict[str, Any] | list[dict[str, Any]]:
        """A tool by name with strict arguments: undeclared ones are an error that names the closest."""
        if tool not in self.TOOLS:
            return {"error": f"Unknown tool: {tool}"}
        accepted = self.arguments(tool)
        unknown = sorted(set(arguments) - set(accepted))
        if unknown:
            hints = [f"{a!r} (did you mean {near[0]!r}?)" if (near := get_close_matches(a, accepted, 1, 0.6)) else repr(a) for a in unknown]
            return {"error": f"Unknown argument(s) for tool {tool!r}: {', '.join(hints)}. Accepted: {', '.join(accepted) or '(none)'}."}
        return getattr(self, tool)(**arguments)
