import pytest
from pyspark.sql import functions as F

from docweave.operators import ranking as R
from docweave.operators import sections as S

E1 = [1.0] + [0.0] * 7
MID = [0.6, 0.8] + [0.0] * 6


def hits(spark, rows):
    return spark.createDataFrame([("q", "c", k, i, s, i) for i, (k, s) in enumerate(rows)], "query_id string, corpus string, chunk_id string, ord int, raw_score double, rank int")


def vectors(spark):
    return spark.createDataFrame([("c", "high", 0, E1), ("c", "low", 1, [0.0, 1.0] + [0.0] * 6), ("c", "mid", 2, MID)], "corpus string, chunk_id string, ord int, embedding array<float>")


@pytest.mark.parametrize("queries", [[("q", E1)], [("q", E1), ("r", MID)]])
def test_dense_scores(spark, queries):
    got = R.dense_scores(vectors(spark), queries).where("query_id = 'q'").orderBy(F.desc("raw_score")).collect()
    assert [r.chunk_id for r in got] == ["high", "mid", "low"]
    assert [r.raw_score for r in got] == pytest.approx([1.0, 0.6, 0.0], abs=1e-6)


@pytest.mark.parametrize(("floor", "kept"), [(None, 3), (0.5, 2), (0.1, 1), (2.0, 3)])
def test_floor(spark, floor, kept):
    c = spark.createDataFrame([("c", 1.0, None, 0)], "corpus string, weight double, max_distance double, corpus_ord int")
    marked = R.apply_floor(R.dense_scores(vectors(spark), [("q", E1)]), R.effective_floor(c, floor))
    assert marked.where("kept").count() == kept


def test_floor_precedence(spark):
    c = spark.createDataFrame([("a", 2.0), ("b", None)], "corpus string, max_distance double")
    assert {r.corpus: r.floor for r in R.effective_floor(c, 0.0, 0.5).collect()} == {"a": 2.0, "b": 0.0}
    assert {r.corpus: r.floor for r in R.effective_floor(c, None, 0.5).collect()} == {"a": 2.0, "b": 0.5}


def fused(spark, dense, sparse, **how):
    return {r.chunk_id: r.score for r in R.fuse(hits(spark, dense), hits(spark, sparse), R.Fusion(**how)).collect()}


def test_fusion_strong_sparse(spark):
    got = fused(spark, [("d1", 0.9), ("weak", 0.001), ("d3", 0.0005)], [("strong", 11.22), ("s2", 2.0)])
    assert got["d1"] == pytest.approx(0.311475, abs=1e-6) and got["strong"] == pytest.approx(0.311475, abs=1e-6)
    assert got["weak"] == pytest.approx(0.011457, abs=1e-6) and got["s2"] == pytest.approx(0.011290, abs=1e-6) and got["d3"] == pytest.approx(0.011111, abs=1e-6)


def test_fusion_ends(spark):
    got = fused(spark, [("a", 0.9), ("b", 0.1)], [("c", 100.0), ("d", 0.01)], alpha=0.0)
    assert got["a"] == got["c"]
    got = fused(spark, [("weak", 0.001)], [("strong", 11.22)], alpha=1.0)
    assert got["weak"] == got["strong"] == 1.0
    got = fused(spark, [("shared", 0.8), ("d2", 0.4)], [("shared", 5.0), ("s2", 1.0)])
    assert got["shared"] == pytest.approx(0.622951, abs=1e-6) and max(got, key=got.get) == "shared"
    assert fused(spark, [], []) == {}


def test_bm25_counts_repeats_and_drops_zero(spark):
    t = spark.createDataFrame([("c", "1", 1, "red fox red"), ("c", "2", 2, "blue fox"), ("c", "3", 3, "green")], "corpus string, chunk_id string, ord int, text string")
    q = spark.createDataFrame([("q", "red fox zebra")], "query_id string, query string")
    got = {r.chunk_id: r.raw_score for r in R.bm25_scores(R.postings(t), R.corpus_stats(R.doc_stats(t)), R.query_terms(q)).collect()}
    assert set(got) == {"1", "2"} and got["1"] > got["2"] > 0


def test_dedup_sections_keeps_input_order(spark):
    rows = [("a", "s1", 0.1), ("b", "s1", 0.9), ("c", "", 0.5), ("d", "", 0.4), ("e", "unstructured:x", 0.3), ("f", "unstructured:x", 0.2), ("g", None, 0.1)]
    df = spark.createDataFrame([("q", k, s, x, i) for i, (k, s, x) in enumerate(rows)], "query_id string, chunk_id string, section_id string, score double, place int")
    assert [r.chunk_id for r in R.dedup_sections(df).orderBy("place").collect()] == list("acdefg")


def test_merge_breaks_ties_by_corpus_then_order(spark):
    c = spark.createDataFrame([("x", 1), ("y", 0)], "corpus string, corpus_ord int")
    df = spark.createDataFrame([("q", "x", 1, 0.5), ("q", "y", 2, 0.5), ("q", "y", 1, 0.5)], "query_id string, corpus string, ord int, score double")
    assert [(r.corpus, r.ord) for r in R.merge(df, c, 2).orderBy("place").collect()] == [("y", 1), ("y", 2)]


@pytest.mark.parametrize(("paths", "title", "structured", "n"), [([["Con", "Over"], ["Con", "Rules"]], "Con", True, 2), ([[], []], "d.md", False, 2), ([[], ["Intro"]], "d.md", True, 3)])
def test_toc(spark, paths, title, structured, n):
    df = spark.createDataFrame([("c", "/x/d.md", i, p) for i, p in enumerate(paths)], "corpus string, source_path string, pos int, heading_path array<string>")
    row = S.toc(df).first()
    assert (row.title, row.structured, row.chunk_count) == (title, structured, n)
