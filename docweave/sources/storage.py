"""Index storage: immutable Parquet versions by corpus, numbered manifests, a leased writer's lock, caches."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import Folder

TABLES = {
    "chunks": "corpus string, source_path string, pos bigint, chunk_id string, heading string, text string, char_offset bigint, char_count bigint, summary string, metadata map<string,string>, heading_path array<string>, section_id string, embedding array<float>",
    "files": "corpus string, source_path string, file_hash string, file_size bigint, modified_at timestamp",
    "documents": "corpus string, source_path string, filename string, markdown string",
    "postings": "corpus string, chunk_id string, ord struct<source_path:string,pos:bigint>, dl bigint, term string, tf bigint",
    "lengths": "corpus string, chunk_id string, source_path string, dl bigint",
    "terms": "corpus string, term string, df bigint",
    "stats": "corpus string, n bigint, avgdl double",
}
CACHES = {
    "converted": "file_hash string, ext string, markdown string",
    "vectors": "key string, embedding array<float>, ts timestamp",
}
#: Kept in the order of a column, so that a search reads only the pages of its terms and hits.
ORDERED = {"postings": "term", "terms": "term", "chunks": "chunk_id"}
KEPT = 2


class LockedError(RuntimeError):
    pass


class Store:
    """Readers follow the newest manifest; writers make a new version of the corpora that they touch and
    then its manifest. Nothing is changed in place, so a reader keeps its snapshot and a failed write
    leaves the current version as it was. A manifest names each corpus's version and its files with
    their sizes; one whose files aren't all there is passed over for the one before.
    All access is through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str, *, lease: float = 60.0):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease
        self.folder = Folder(spark, self.root)
        self._whole: dict[int, bool] = {}
        self._loaded: dict[int, dict[str, Any]] = {}

    # -- manifests -----------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        """Of all manifests, newest first."""
        names = [e.name for e in self.folder.listed() if e.name.startswith("manifest-") and e.name.endswith(".json")]
        return sorted((int(n[9:-5]) for n in names if n[9:-5].isdigit()), reverse=True)

    def _load(self, number: int) -> dict[str, Any] | None:
        if number not in self._loaded:
            try:
                self._loaded[number] = json.loads(self.folder.read(f"manifest-{number}.json"))
            except Exception:  # half written, or gone meanwhile
                return None
        return self._loaded[number]

    def _dir(self, version: str, table: str, corpus: str) -> str:
        return f"{version}/{table}/corpus={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(corpus)}"

    def _listed(self, version: str, table: str, corpus: str) -> list[list]:
        return sorted([e.name, e.size] for e in self.folder.listed(self._dir(version, table, corpus)) if e.name.startswith("part-"))

    def _is_whole(self, number: int, manifest: dict[str, Any]) -> bool:
        if number not in self._whole:
            files = ((c, e["version"], t, f) for c, e in manifest["corpora"].items() for t, f in e["files"].items())
            self._whole[number] = all(self._listed(v, t, c) == f for c, v, t, f in files)
        return self._whole[number]

    def manifest(self) -> dict[str, Any]:
        """The newest manifest with all its files; an empty one if there is none."""
        for number in self.numbers():
            found = self._load(number)
            if found and self._is_whole(number, found):
                return found
        return {"number": 0, "corpora": {}, "properties": {}}

    # -- tables --------------------------------------------------------------------------------

    def read(self, table: str, corpora: Iterable[str] | None = None) -> DataFrame:
        """The rows of these corpora (all, without any), and only their files."""
        entries = self.manifest()["corpora"]
        wanted = set(entries) if corpora is None else set(corpora) & set(entries)
        by_version: dict[str, list[str]] = {}
        for c in sorted(wanted):
            if entries[c]["files"].get(table):
                by_version.setdefault(entries[c]["version"], []).append(f"{self.root}/{self._dir(entries[c]['version'], table, c)}")
        made = [self.spark.read.option("basePath", f"{self.root}/{v}/{table}").schema(TABLES[table]).parquet(*paths) for v, paths in by_version.items()]
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        return reduce(DataFrame.unionByName, [df.select(*columns) for df in made]) if made else self.spark.createDataFrame([], TABLES[table])

    def commit(self, tables: dict[str, DataFrame], corpora: Iterable[str], properties: dict[str, Any] | None = None) -> int:
        """Make these tables the rows of these corpora; other corpora stay as they are."""
        corpora, version = list(corpora), f"v{time.time_ns()}-{uuid.uuid4().hex[:6]}"

        def write(item: tuple[str, DataFrame]) -> None:
            name, df = item
            if name in ORDERED:
                df = df.repartitionByRange("corpus", ORDERED[name]).sortWithinPartitions("corpus", ORDERED[name])
            df.write.partitionBy("corpus").parquet(f"{self.root}/{version}/{name}")

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables.items()))
        before = self.manifest()
        entries = dict(before["corpora"])
        for c in corpora:
            entries[c] = {"version": version, "files": {t: f for t in tables if (f := self._listed(version, t, c))}}
        number = max([0, *self.numbers()]) + 1
        made = {"number": number, "corpora": entries, "properties": before["properties"] | (properties or {})}
        self.folder.replace(f"manifest-{number}.json", json.dumps(made).encode())
        self._clean(version)
        return number

    def _clean(self, newest: str) -> None:
        """Delete manifests but the last ``KEPT`` that can be read, and data that none of those names."""
        kept = [(n, m) for n in self.numbers() if (m := self._load(n))][:KEPT]
        used = {(e["version"], t, c) for _, m in kept for c, e in m["corpora"].items() for t in e["files"]}
        for n in self.numbers():
            if n not in {k for k, _ in kept}:
                self.folder.delete(f"manifest-{n}.json")
        for v in (e.name for e in self.folder.listed() if e.folder and e.name.startswith("v") and e.name != newest):
            live = {self._dir(*x) for x in used if x[0] == v}
            if not live:
                self.folder.delete(v)
                continue
            for t in (e.name for e in self.folder.listed(v) if e.folder):
                for d in (e.name for e in self.folder.listed(f"{v}/{t}") if e.folder):
                    if f"{v}/{t}/{d}" not in live:
                        self.folder.delete(f"{v}/{t}/{d}")

    def indexed_at(self) -> int:
        numbers = self.numbers()
        return self.folder.modified(f"manifest-{numbers[0]}.json") if numbers else 0

    # -- caches --------------------------------------------------------------------------------

    def cached(self, name: str) -> DataFrame:
        if not self.folder.listed(f"cache/{name}"):
            return self.spark.createDataFrame([], CACHES[name])
        return self.spark.read.schema(CACHES[name]).parquet(f"{self.root}/cache/{name}")

    def remember(self, name: str, rows: DataFrame) -> None:
        """Add rows to a cache; only the holder of the lock does."""
        rows.select(*self.spark.createDataFrame([], CACHES[name]).columns).write.mode("append").parquet(f"{self.root}/cache/{name}")

    def forget(self) -> None:
        self.folder.delete("cache")

    # -- lock ----------------------------------------------------------------------------------

    @contextmanager
    def lock(self, corpus: str) -> Iterator[None]:
        """One writer at a time; a second one fails at once. The holder renews its lease while it works;
        a lock whose lease is over, or whose process on this host is gone, is taken over."""
        name, owner = f"{corpus}.lock", uuid.uuid4().hex

        def note() -> bytes:
            return json.dumps({"owner": owner, "host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + self.lease}).encode()

        try:
            self.folder.make()
            made = self.folder.create(name, note())
            if not made and self._is_dead(name) and self.folder.move(name, f"{name}.{owner}"):
                self.folder.delete(f"{name}.{owner}")
                made = self.folder.create(name, note())
        except Exception as e:
            raise LockedError(f"could not acquire lock for corpus {corpus}: {str(e)[:200]}; refusing to index") from e
        if not made:
            raise LockedError(f"indexing in progress for corpus {corpus}")
        over = threading.Event()

        def renew() -> None:
            while not over.wait(self.lease / 3):
                if self._holder(name).get("owner") != owner:
                    return
                self.folder.replace(name, note())

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            over.set()
            keeper.join()
            if self._holder(name).get("owner") == owner:
                self.folder.delete(name)

    def _holder(self, name: str) -> dict[str, Any]:
        try:
            return json.loads(self.folder.read(name))
        except Exception:
            return {}

    def _is_dead(self, name: str) -> bool:
        held = self._holder(name)
        if not held:  # being written, or left half written
            entry = self.folder.entry(name)
            return entry is not None and time.time() - self.folder.modified(name) > self.lease
        if held["until"] < time.time():
            return True
        if held["host"] != socket.gethostname():
            return False
        try:
            os.kill(held["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return False


def recent(rows: DataFrame, seconds: float) -> DataFrame:
    """The rows of (..., ts) that haven't expired."""
    return rows.where(F.col("ts") > F.current_timestamp() - F.expr(f"interval {int(seconds)} seconds"))
