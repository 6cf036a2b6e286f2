"""Versions, recovery, the lock, caches, live files, and what the engine stores for a search."""

import json
import math
import os
import re
import sys
import time
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.cli import parity, parser, request
from docweave.config import Config
from docweave.functions import text as X
from docweave.operators import evaluate as E
from docweave.operators import ranking as R
from docweave.plans.embed import HashingEmbedder, ModelEmbedder, model_name
from docweave.plans.engine import Engine
from docweave.sources.files import scan, suffix_glob
from docweave.sources.storage import LockedError, Store, recent

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module

TEXTS = {
    "a": {"one.md": "zebra lion lion grass", "two.md": "zebra grass grass tree river", "none.md": "a !", "deep/three.md": "lion sleeps", "skip/four.md": "zebra hidden", "big.MD": "Zebra upper"},
    "b": {"five.md": "zebra zebra zebra", "six.txt": "river bank"},
}


def build(spark, root, **more):
    for name, files in TEXTS.items():
        for f, t in files.items():
            path = root / "skip" / name / f
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(t)
    raw = {
        "corpora": [{"name": n, "path": str(root / "skip" / n)} for n in TEXTS],
        "search": {"hybrid": True},
        "embedding": {"dimensions": 384},
        "indexing": {"data_dir": str(root / "index"), "exclude_dirs": ["skip"]},
        "upload": {"allow": ["a"]},
    }
    return Engine(spark, Config.from_dict(raw), **more)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    e = build(spark, root)
    e.root = root / "skip"
    e.index()
    return e


def test_scan_below_the_root(engine, spark):
    """Excluded folders count below the root alone; suffixes match in either case."""
    files = scan(spark, engine.config.corpora[0], exclude_dirs=["skip"])
    assert sorted(r.filename for r in files.select("filename").collect()) == ["big.MD", "none.md", "one.md", "three.md", "two.md"]
    assert suffix_glob([".md"]) == "*.[mM][dD]" and suffix_glob([".md", ".7z"]) == "{*.[mM][dD],*.7[zZ]}"
    plan = files.select("source_path")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def brute_bm25(query):
    out = {}
    for corpus, files in TEXTS.items():
        docs = {f: [w for w in re.findall(r"\w{2,}", t.lower()) if w not in X.STOP_WORDS] for f, t in files.items() if not f.startswith("skip/")}
        n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
        for f, words in docs.items():
            tf, score = Counter(words), 0.0
            for w in re.findall(r"\w{2,}", query.lower()):
                df = sum(w in d for d in docs.values())
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avg)) if tf[w] else 0
            if score:
                out[corpus, f.rsplit("/", 1)[-1]] = score
    return out


def test_stored_statistics_count_chunks_without_words(engine):
    from docweave.plans.search import sparse_scores

    got = sparse_scores(engine.snapshot(), [("q", "zebra grass lion", [])], F.lit(True)).collect()
    want = brute_bm25("zebra grass lion")
    assert {(r.corpus, r.ord.source_path.rsplit("/", 1)[-1]): pytest.approx(r.raw_score, abs=1e-8) for r in got} == want
    assert {r.corpus: r.n for r in engine.store.read("stats").collect()} == {"a": 5, "b": 2}
    assert engine.store.read("postings").where("term = 'zebra'").count() == 4


def test_search_in_many_dimensions(engine, spark):
    out = engine.search("zebra grass", top_k=3, hybrid=False)
    assert out["results"][0]["filename"] in ("two.md", "one.md") and out["total"] == 3
    v = np.random.default_rng(0).normal(size=(50, 1024))
    frame = spark.createDataFrame([("c", i, i, [float(x) for x in r]) for i, r in enumerate(v)] + [("c", 60, 60, None), ("c", 61, 61, [1.0])], "corpus string, chunk_id int, ord int, embedding array<float>").coalesce(1)
    asked = [(str(i), v[i].tolist()) for i in range(3)]
    for k in (None, 4):
        got = R.dense_scores(frame, asked, k).collect()
        assert len(got) == (150 if k is None else 12)
        for r in got:
            assert r.raw_score == pytest.approx(float(v[int(r.query_id)].astype(np.float32) @ v[r.chunk_id].astype(np.float32)), abs=1e-3)
        tops = {q: sorted((-r.raw_score, r.chunk_id) for r in got if r.query_id == q)[:4] for q, _ in asked}
        for q, x in asked:
            assert [i for _, i in tops[q]] == np.argsort(-(v.astype(np.float32) @ np.array(x)), kind="stable")[:4].tolist()
    assert R.dense_scores(frame, []).count() == 0


def test_queries_past_the_broadcast_bound_take_several_scans(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BYTES", 64)
    frame = spark.createDataFrame([("c", i, i, [float(i), 1.0]) for i in range(5)], "corpus string, chunk_id int, ord int, embedding array<float>")
    got = R.dense_scores(frame, [(str(q), [1.0, float(q)]) for q in range(9)])
    assert {(r.query_id, r.chunk_id): r.raw_score for r in got.collect()} == {(str(q), i): float(i + q) for q in range(9) for i in range(5)}


def test_one_changed_file_rewrites_one_corpus(engine):
    before = engine.store.manifest()
    (engine.root / "b" / "six.txt").write_text("river quagga")
    stats = engine.index()
    after = engine.store.manifest()
    assert [(s["files_indexed"], s["files_skipped"]) for s in stats] == [(0, 5), (1, 1)]
    assert after["corpora"]["a"] == before["corpora"]["a"] and after["corpora"]["b"] != before["corpora"]["b"]
    assert after["number"] == before["number"] + 1 and after["properties"]["metric"] == "ip"
    engine.index()
    assert engine.store.manifest()["number"] == after["number"]  # nothing changed, nothing written
    assert engine.search("quagga", top_k=1)["results"][0]["filename"] == "six.txt"


def test_vanished_files_arent_found(engine):
    path = engine.root / "b" / "five.md"
    text = path.read_text()
    assert engine.search("zebra zebra", corpora=["b"])["results"][0]["filename"] == "five.md"
    os.unlink(path)
    try:
        assert "five.md" not in {r["filename"] for r in engine.search("zebra zebra")["results"]}
        assert {d["source_path"].rsplit("/", 1)[-1]: d["file_size"] > 0 for d in engine.list_documents("b")["documents"]} == {"five.md": False, "six.txt": True}
        assert engine.get_document("b", str(path))["error"].startswith("Document not found")
    finally:
        path.write_text(text)


def test_a_damaged_version_is_passed_over(spark, tmp_path):
    e = build(spark, tmp_path)
    e.index()
    (tmp_path / "skip" / "a" / "one.md").write_text("new words")
    e.index("a")
    now = e.store.manifest()
    version = now["corpora"]["a"]["version"]
    part = next(f for f in (tmp_path / "index" / version / "chunks" / "corpus=a").iterdir() if f.name.startswith("part-"))
    part.write_bytes(part.read_bytes()[:-10])
    fresh = Store(spark, str(tmp_path / "index"))
    assert fresh.manifest()["number"] == now["number"] - 1
    assert fresh.read("chunks").where("text = 'zebra lion lion grass'").count() == 1
    (tmp_path / "index" / f"manifest-{now['number'] + 1}.json").write_text('{"number": ')  # a killed writer
    assert Store(spark, str(tmp_path / "index")).manifest()["number"] == now["number"] - 1
    e.store = fresh
    e.index("a")
    assert Store(spark, str(tmp_path / "index")).read("chunks").where("text = 'new words'").count() == 1
    assert len(fresh.numbers()) <= 2
    for n in fresh.numbers():
        (tmp_path / "index" / f"manifest-{n}.json").unlink()
    assert fresh.read("chunks").count() == 0


def test_versions_without_a_manifest_go(spark, tmp_path):
    e = build(spark, tmp_path)
    for i in range(4):
        (tmp_path / "skip" / "b" / "six.txt").write_text(f"river {i}")
        e.index()
    used = {c["version"] for n in e.store.numbers() for c in e.store._load(n)["corpora"].values()}
    assert {d for d in os.listdir(tmp_path / "index") if d.startswith("v")} == used and len(e.store.numbers()) == 2
    assert e.search("river", corpora=["b"])["total"] >= 1 and e.store.read("files").count() == 7


def test_lock_dies_with_its_process(spark, tmp_path):
    store = Store(spark, str(tmp_path), lease=3)
    with store.lock("index"):
        time.sleep(4)  # longer than the lease: it is renewed
        with pytest.raises(LockedError, match="indexing in progress"), Store(spark, str(tmp_path), lease=3).lock("index"):
            pass
    assert not os.path.exists(tmp_path / "index.lock")
    held = {"owner": "x", "host": "elsewhere", "pid": 1, "until": time.time() + 60}
    for dead in ({"until": time.time() - 1}, {"host": os.uname().nodename, "pid": 2**22 + 1}):
        (tmp_path / "index.lock").write_text(json.dumps(held | dead))
        with store.lock("index"):
            pass
    (tmp_path / "index.lock").write_text(json.dumps(held))
    with pytest.raises(LockedError), store.lock("index"):
        pass


def test_texts_are_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    load = lambda name: lambda texts: _logged(str(log), texts)
    e = build(spark, tmp_path, embedder=ModelEmbedder("tiny", 4, load))
    assert e.embedder.model == "sentence-transformers/tiny" == model_name("sentence-transformers/tiny")
    (tmp_path / "skip" / "b" / "copy.md").write_text(TEXTS["a"]["one.md"])
    e.index()
    seen = log.read_text().splitlines()
    assert sorted(seen) == sorted(set(seen)) and len(seen) == 7
    (tmp_path / "skip" / "b" / "copy2.md").write_text(TEXTS["a"]["two.md"])
    e.index()
    assert len(log.read_text().splitlines()) == 7  # known by its text
    e.index("b", force=True)
    assert len(log.read_text().splitlines()) > 7  # caches are dropped
    v = e.store.read("chunks").select("embedding").first().embedding
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and len(e.search("zebra", hybrid=False)["results"]) == 5


def _logged(log, texts):
    with open(log, "a") as f:
        f.writelines(f"{t}\n" for t in texts if len(texts) > 1 or t != "zebra")
    return np.array([[len(t), t.count("e"), 1, 0] for t in texts], float)


def test_force_keeps_nothing_of_files_that_fail(spark, tmp_path):
    e = build(spark, tmp_path, plugins={".txt": _fails_later(tmp_path / "flag")})
    e.index()
    assert e.store.read("chunks").where("source_path like '%six.txt'").count() == 1
    (tmp_path / "flag").write_text("x")
    stats = {s["corpus"]: s for s in e.index(force=True)}
    assert [x["file"].rsplit("/", 1)[-1] for x in stats["b"]["errors"]] == ["six.txt"]
    assert e.store.read("chunks").where("source_path like '%six.txt'").count() == 0 and e.store.read("files").count() == 6


def _fails_later(flag):
    def convert(raw):
        if os.path.exists(flag):
            raise ValueError("no")
        return raw.decode()

    return convert


def test_recent(spark):
    rows = spark.sql("SELECT 1 AS k, current_timestamp() - INTERVAL 50 SECONDS AS ts UNION ALL SELECT 2, current_timestamp() - INTERVAL 200 SECONDS")
    assert [r.k for r in recent(rows, 100).collect()] == [1]


def spans_of(raw):
    """A made-up page: a line a span, its size after a bar."""
    for i, line in enumerate(raw.decode().split("\n")):
        t, _, size = line.partition("|")
        if t == "broken":
            raise ValueError("broken file")
        yield 1, i, 0, 0, 0, t, float(size)


def test_pdf_headings_come_from_spans(spark, tmp_path):
    home = tmp_path / "c"
    home.mkdir()
    (home / "good.pdf").write_text("Title|24\nsome body text of the page|10\nPart one|18\nmore body text here|10")
    (home / "flat.pdf").write_text("all of one size|10\nstill the same|10")
    (home / "bad.pdf").write_text("broken|1")
    (home / "page.html").write_text("<h1>T</h1>")
    made = tmp_path / "made"
    raw = {"corpora": [{"name": "c", "path": str(home), "extensions": [".pdf", ".html"]}], "indexing": {"data_dir": str(tmp_path / "index")}}
    e = Engine(spark, Config.from_dict(raw), spans=spans_of, plugins={".pdf": _plain(str(made))})
    assert e.index("c")["files_indexed"] == 4
    docs = {r.filename: r.markdown for r in e.store.read("documents").collect()}
    assert docs["good.pdf"].startswith("# Title\n\nsome body text of the page\n## Part one")
    assert docs["flat.pdf"] == "plain flat" and docs["bad.pdf"] == "plain" and docs["page.html"] == "# T"
    assert len(made.read_text().split()) == 2
    (home / "again.pdf").write_bytes((home / "flat.pdf").read_bytes())
    e.index("c")  # known by its content: not converted again
    assert len(made.read_text().split()) == 2 and e.store.read("documents").count() == 5
    none = Engine(spark, Config.from_dict(raw | {"indexing": {"data_dir": str(tmp_path / "other")}}), spans=spans_of)
    assert {x["file"].rsplit("/", 1)[-1] for x in none.index("c")["errors"]} == {"flat.pdf", "bad.pdf", "again.pdf"}


def _plain(log):
    def convert(raw):
        with open(log, "a") as f:
            f.write("x\n")
        return "plain flat" if b"same" in raw else "plain"

    return convert


def test_golden_sets(engine, tmp_path):
    golden = {"queries": ["zebra", {"query": "sleeps", "corpus": "a", "expect": "THREE.md"}, {"query": "river", "corpora": ["b"], "expected": ["six"]}, {"query": "upper", "expect": ["nowhere"]}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    loaded = E.load_golden(str(tmp_path / "g.json"))
    assert [g["expect"] for g in loaded] == [[], ["THREE.md"], ["six"], ["nowhere"]] and loaded[2]["corpus"] == ["b"]
    out = engine.evaluate(loaded, k=3)
    assert out["hybrid"]["n_scored"] == 3 and out["hybrid"]["recall"] == pytest.approx(2 / 3, abs=1e-4) and out["dense"]["hit_at_1"] == pytest.approx(2 / 3, abs=1e-4)
    (tmp_path / "g.yaml").write_text("- query: x\n  expect: [a, 2]\n")
    pytest.importorskip("yaml")
    assert E.load_golden(str(tmp_path / "g.yaml"))[0]["expect"] == ["a", "2"]
    for name, text in (("h.json", "[{}]"), ("h.json", "3"), ("h.txt", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            E.load_golden(str(tmp_path / name))


def test_downloads(engine):
    got = engine.download("a", "one.md")
    assert got["content"] == TEXTS["a"]["one.md"].encode() and got["size_bytes"] == len(got["content"])
    assert "traversal" in engine.download("a", "../b/five.md")["error"] and "traversal" in engine.download("a", "/etc/passwd")["error"]
    assert engine.download("a", "gone.md")["error"] == "File not found: gone.md" and engine.download("a", "deep")["error"] == "Not a file: deep"
    assert engine.download("x", "one.md")["error"] == "corpus not found: x"


def test_upload_answers(engine):
    up = engine.upload("a", "new.md", b"fresh")
    assert {k: up[k] for k in ("corpus", "filename", "size_bytes", "saved", "indexed")} == {"corpus": "a", "filename": "new.md", "size_bytes": 5, "saved": True, "indexed": True}
    gone = engine.delete("a", "new.md")
    assert gone["deleted"] and gone["indexed"] and gone["size_bytes"] == 5 and gone["index"]["files_indexed"] == 0
    assert engine.call("status", {"x": 1, "a": 2})["error"] == "Unknown argument(s) for tool 'status': 'a', 'x'. Accepted: (none)."


def test_command_line_covers_every_tool():
    for tool, (accepted, taken) in parity().items():
        assert accepted == taken, tool
    p = parser()
    assert request(p.parse_args(["search", "zebra", "--corpora", "a,b", "--no-hybrid", "--top-k", "3"])) == ("search", {"query": "zebra", "corpora": ["a", "b"], "hybrid": False, "top_k": 3})
    assert request(p.parse_args(["get-document", "--corpus", "a", "--path", "/x"])) == ("get_document", {"corpus": "a", "source_path": "/x"})
    assert request(p.parse_args(["call", "get_toc", '{"corpus": "a"}'])) == ("get_toc", {"corpus": "a"})


def test_streams_replace_a_files_chunks(spark, tmp_path):
    from docweave.streaming.incremental import current, engine_stream, file_stream, index_stream

    e = build(spark, tmp_path)
    for _ in range(2):
        engine_stream(e, "a", str(tmp_path / "cp")).awaitTermination()
        assert e.store.read("files").count() == 6 and e.store.read("chunks").count() == 6  # the stream has no excluded folders
        e.upsert(scan(spark, e.config.corpora[0]), ["a"])
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for text in ("# T\n\n## S\nbody\n\n## U\nx", "short"):
        (tmp_path / "in" / "f.md").write_text(text)
        stream = file_stream(spark, str(tmp_path / "in"), "c", [".md"])
        index_stream(stream, out, str(tmp_path / f"cp{len(text)}")).awaitTermination()
        if text != "short":
            os.rename(f"{out}/batch=0", f"{out}/batch=7")
            assert current(spark, out).count() == 3
    os.rename(f"{out}/batch=0", f"{out}/batch=8")
    assert [r.text for r in current(spark, out).collect()] == ["short"]


def test_model_must_be_handed_in(spark, tmp_path):
    with pytest.raises(ValueError, match="embedder"):
        Engine(spark, Config.from_dict({"embedding": {"model": "all-small"}, "indexing": {"data_dir": str(tmp_path)}}))


def test_a_floor_needs_an_inner_product_index(spark, tmp_path):
    class Euclid(HashingEmbedder):
        metric = "l2"

    e = build(spark, tmp_path, embedder=Euclid(16))
    e.index()
    assert e.search("zebra", hybrid=False)["total"] > 0
    with pytest.raises(RuntimeError, match="inner product"):
        e.search("zebra", max_distance=0.5)
