import base64
import os

import pytest

from docweave.config import Config
from docweave.plans.embed import QueryCache
from docweave.plans.engine import Engine
from docweave.sources.convert import convert, html_to_markdown


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    for name, files in {"alpha": {"one.md": "# Guide\n\n## Install\npip install the package\n\n## Usage\nrun the server with a config", "two.txt": "plain notes about zebras and lions", "skip.bin": "x"}, "beta": {"three.md": "# Zoo\n\n## Zebras\nzebras eat grass\n\n## Lions\nlions sleep"}}.items():
        os.makedirs(root / name / "node_modules")
        for f, t in files.items():
            (root / name / f).write_text(t)
        (root / name / "node_modules" / "hidden.md").write_text("zebras hidden")
    config = Config.from_dict(
        {
            "corpora": [{"name": n, "path": str(root / n), "weight": w} for n, w in (("alpha", 1.0), ("beta", 1.2))],
            "search": {"hybrid": True},
            "embedding": {"dimensions": 32},
            "indexing": {"data_dir": str(root / "index"), "exclude_dirs": ["node_modules"]},
            "upload": {"allow": ["alpha"]},
        }
    )
    e = Engine(spark, config)
    e.root = root
    assert [(s["corpus"], s["files_indexed"], s["errors"]) for s in e.index()] == [("alpha", 2, []), ("beta", 1, [])]
    return e


def test_search_modes(engine):
    out = engine.search("zebras grass", top_k=3)
    assert set(out) == {"results", "total", "query", "hybrid", "return_mode"}
    assert any(r["location"].endswith("three.md#Zebras") for r in out["results"][:2])  # each corpus's best ties
    docs = engine.search("zebras grass", top_k=3, corpora=["beta"], return_mode="documents")["results"]
    assert docs[0]["filename"] == "three.md" and docs[0]["text"].startswith("# Zoo")
    sections = engine.search("zebras grass", top_k=3, section_mode=True, hybrid=False)["results"]
    assert any(s["heading"] == "Zebras" for s in sections)
    assert engine.search("zebras grass", top_k=2, return_mode="auto")["return_mode"] == "chunks"
    inside = engine.search("sleep", section_filter="Zoo Lions")["results"]
    assert inside and all(r["heading_path"] in (None, ["Zoo", "Lions"]) for r in inside)


def test_errors(engine):
    assert engine.search("x", top_k=0)["error"] == "top_k must be >= 1"
    assert engine.search("  ")["error"] == "query required"
    assert engine.search("x" * 10_001)["query"] == "x" * 100 + "..."
    assert engine.search("x", return_mode="all")["error"] == "Invalid return_mode: 'all'. Must be 'chunks', 'documents', or 'auto'."
    assert engine.search("x", corpora=["nope"])["error"] == "corpus not found: nope"
    assert engine.search("x", section_filter="No Such")["error"] == "section not found: No Such"
    assert "did you mean 'top_k'?" in engine.call("search", {"query": "x", "topk": 1})["error"]
    assert engine.get_chunk("nope")["error"] == "Chunk not found: nope"


def test_floor_empties_the_dense_list(engine):
    out = engine.search("quark", hybrid=False, max_distance=0.0)
    assert out["results"] == [] and out["filtered_by_distance"] > 0 and set(out) == {"results", "total", "query", "max_distance_applied", "filtered_by_distance"}


def test_lookups(engine):
    hit = engine.search("install package", corpora=["alpha"])["results"][0]
    assert engine.get_chunk(hit["chunk_id"])["source_path"] == hit["source_path"]
    assert engine.get_document("alpha", hit["source_path"])["chunk_count"] == 3
    assert [d["chunk_count"] for d in engine.list_documents("beta")["documents"]] == [3]
    assert {s["corpus"]: s["chunks"] for s in engine.status()} == {"alpha": 4, "beta": 3}
    assert engine.get_toc("beta")["documents"][0]["headings"] == ["Zebras", "Lions"]
    assert engine.get_toc("beta", "/gone.md")["structured"] is False


def test_incremental_upload_and_delete(engine):
    assert [s["files_skipped"] for s in engine.index()] == [2, 1]
    up = engine.upload("alpha", "../new.md", base64.b64encode(b"# N\n\nfresh quagga text").decode())
    assert up["filename"] == "new.md" and up["index"]["files_indexed"] == 1
    assert engine.search("quagga", top_k=1)["results"][0]["filename"] == "new.md"
    (engine.root / "alpha" / "new.md").write_text("# N\n\nother words")
    engine.index("alpha")
    assert all("quagga" not in r["summary"] for r in engine.search("quagga")["results"])
    assert engine.delete("alpha", "new.md")["deleted"]
    assert {s["corpus"]: s["files"] for s in engine.status()} == {"alpha": 2, "beta": 1}
    assert engine.upload("beta", "x.md", b"")["error"] == "Corpus 'beta' does not accept uploads"
    assert engine.upload("alpha", "x.exe", b"")["error"].startswith("Extension '.exe' not allowed")
    assert engine.upload("alpha", "x.md", "%%%")["error"] == "Invalid base64 content"
    assert engine.delete("alpha", "gone.md")["error"] == "File not found: gone.md"


def test_lock(engine):
    with engine.store.lock("index"):
        assert engine.index("alpha")["error"] == "indexing in progress for corpus alpha"


def test_config_checks():
    assert Config.from_dict({}).search.hybrid is False and Config().search.hybrid is True
    for bad in ({"search": {"max_distance": -1}}, {"search": {"max_distance": True}}, {"corpora": [{"name": "a", "path": "/", "max_distance": "x"}]}, {"chunking": {"max_size": 0}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)
    assert Config.from_dict({"corpora": [{"name": "a", "path": "/", "weight": "x", "extensions": ["PDF"]}]}).corpora[0].extensions == [".pdf"]


def test_query_cache_expires():
    class Fake:
        model, dims, calls = "m", 1, 0

        def query(self, text):
            self.calls += 1
            return [1.0]

    now = [0.0]
    fake = Fake()
    cache = QueryCache(fake, most=1, ttl=10, clock=lambda: now[0])
    cache.query("a"), cache.query("a")
    now[0] = 11
    cache.query("a"), cache.query("b")
    assert cache.stats() == {"hits": 1, "misses": 3, "evictions": 1, "size": 1} and fake.calls == 3


def test_converters():
    assert html_to_markdown("<h1>T</h1><p>a <b>b</b></p><ul><li>x<li>y</ul><table><tr><th>k<td>v</tr></table>").startswith("# T\n\na **b**")
    assert convert("a.csv", b"x,y\n1,2") == "| x | y |\n|---|---|\n| 1 | 2 |"
    assert convert("a.md", b"\xff\r\nb") == "�\nb"
    with pytest.raises(ValueError, match="Unsupported file extension: .exe"):
        convert("a.exe", b"")


def test_stream(spark, tmp_path):
    from docweave.streaming.incremental import file_stream, index_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\n## S\nbody")
    for n in (2, 3):
        index_stream(file_stream(spark, str(tmp_path / "in"), "c", [".md"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (2 if n == 2 else 3)
        (tmp_path / "in" / "b.md").write_text("more")
