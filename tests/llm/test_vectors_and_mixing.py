import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import mixing, topk


def brute_topk(rows, queries, k):
    """Every row of ``queries`` (places in ``rows``) against every other row."""
    ok = {r: (i, np.floor(256 * np.array(v)).astype(int)) for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for r in queries:
        if r in ok:
            q, x = ok[r]
            hits = sorted((-int(x @ y), i) for s, (i, y) in ok.items() if s != r and len(y) == len(x))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 40, 300])
def test_topk_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.normal(0, 0.3, 8), 1)]) for i in range(size)]
    rows += [(10_000, None), (10_001, [0.1, None]), (10_002, [float("nan")] * 8), (10_003, [float("inf")] * 8), (10_004, [0.5, 0.5]), (10_005, [0.5, -0.5]), (None, [0.1] * 8), (10_006, [])]
    d = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, lane int").repartition(3)
    ask = d.where((F.col("vec_id") % 5 == 0) | (F.col("vec_id") > 9000))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d, ask, k=5, block_rows=32, lane_rows=64, query_rows=16).collect())
    assert got == brute_topk(rows, [r for r, (i, _) in enumerate(rows) if i is not None and (i % 5 == 0 or i > 9000)], 5)


def test_topk_repeats_and_empty(spark):
    d = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [1.0]), (2, [1.0]), (3, [-1.0])], "vec_id bigint, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(d, d.where("vec_id = 3"), k=3).orderBy("rank").collect()]
    assert got == [(1, 1, -65536), (2, 1, -65536), (3, 2, -65536)]
    none = d.where("false")
    assert topk.search(none, none).count() == 0 and topk.search(d, none).count() == 0


def test_topk_of_repeated_ids(spark):
    """A query's own row is left out once: an equal row and another vector of its id are candidates."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(5)]
    rows = [(int(i), vectors[j]) for i, j in zip(rng.integers(0, 6, 60), rng.integers(0, 5, 60), strict=True)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d, d.where("vec_id % 2 = 0"), k=7, block_rows=8, lane_rows=16).collect())
    assert got == brute_topk(rows, [r for r, (i, _) in enumerate(rows) if i % 2 == 0], 7)


@pytest.mark.parametrize("size, kind", [(2.0**18, np.int64), (2.0**14, np.float64)])
def test_topk_of_large_components(spark, size, kind):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, size, 6)]) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert topk._exact(6, int(256 * size * 4), int(256 * size * 4)) is kind
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d, d.where("vec_id % 20 = 0"), k=5, block_rows=64).collect())
    assert got == brute_topk(rows, range(0, 200, 20), 5)
    with pytest.raises(ValueError, match="64 bits"):
        topk._exact(6, 1 << 31, 1 << 31)


def test_lists_are_not_read_whole_when_bounds_decide():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.02, (4000, 8)))
    best = np.full((6, 8), 200.0)
    scan = topk.NoRandomAccess(np.array([-1]), np.array([-1]), np.full((1, 8), 100.0), 5)
    scan.block(np.arange(6), best)
    scan.block(np.arange(6, 4006), x)
    assert scan.decided < 0.2 * scan.listed and scan.resolved < 0.2 * scan.listed and sorted(scan.names[0]) == [0, 1, 2, 3, 4]


def test_nothing_is_looked_up():
    """The walk is right on entries alone: what it hasn't read may change."""
    rng = np.random.default_rng(3)
    x, asked = np.floor(256 * rng.normal(0, 0.1, (500, 6))), np.floor(256 * rng.normal(0, 0.1, (9, 6)))
    for few in (1, 64, 1000):
        scan = topk.NoRandomAccess(np.arange(9), np.arange(9) - 100, asked, 4, few=few)
        for at in range(0, 500, 100):
            scan.block(np.arange(at, at + 100), x[at : at + 100])
        want = [sorted(((-s, i) for i, s in enumerate(x @ q)))[:4] for q in asked]
        assert scan.names.tolist() == [[i for _, i in w] for w in want] and scan.best.tolist() == [[-s for s, _ in w] for w in want]
        assert 0 < scan.decided <= scan.resolved <= scan.listed


def corpus(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(-1, None, "big"), (-2, "", None), (-3, "a b c", None), (-4, "a b", None)]
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id bigint, text string, source string, tokens int, key int, copies int")


def test_mixing_meets_its_targets(spark):
    d = corpus(spark, {"big": 900, "mid": 150, "small": 40})
    got = mixing.mix(d, entropy_share=0.9, max_repeats=3.0, block_rows=16).toPandas()
    assert len(got) == d.count()
    got["key"] = got.source.map(lambda s: s if isinstance(s, str) else "<null>")
    by = got.groupby("key").agg(tokens=("n_tokens", "sum"), weight=("weight", "first"))
    total = by.tokens.sum()
    got["read"] = got.n_tokens * got.copies
    read = got.groupby("key").read.sum()
    p = by.tokens / total
    # the weights are the shares to one exponent
    ratio = np.log(by.weight / by.weight["big"]) / np.log(p / p["big"]).where(p.index != "big")
    exponent = float(ratio.dropna().iloc[0])
    assert np.allclose(ratio.dropna(), exponent, atol=1e-6) and 0 <= exponent <= 1
    most = (by.weight * total / by.tokens).max()
    entropy = -(by.weight * np.log(by.weight)).sum()
    assert most <= 3.0 + 1e-6 and (entropy == pytest.approx(0.9 * np.log(len(by)), abs=1e-5) or most == pytest.approx(3.0, abs=1e-5))
    for s in by.index:  # within the quota, and less than the largest row below it
        quota = math.floor(by.weight[s] * total + 1e-6)
        assert quota - 30 <= read[s] <= quota
        c = got[(got.key == s) & (got.n_tokens > 0)].copies
        assert c.max() - c.min() <= 1
    again = mixing.mix(d.repartition(7), entropy_share=0.9, max_repeats=3.0, block_rows=16).toPandas()
    assert sorted(zip(again.doc_id, again.copies, strict=True)) == sorted(zip(got.doc_id, got.copies, strict=True))


def test_mixed_rows_are_the_plan(spark):
    d = corpus(spark, {"big": 300, "small": 20})
    plan = {r.doc_id: r.copies for r in mixing.mix(d, max_repeats=2.0).collect()}
    out = mixing.mixed(d, max_repeats=2.0)
    assert out.columns == d.columns
    seen = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert seen == {k: v for k, v in plan.items() if v}


def test_mixing_odd_tables(spark):
    d = corpus(spark, {"one": 5})
    natural = mixing.mix(d, entropy_share=None, max_repeats=None).where("n_tokens > 0").collect()
    assert {r.copies for r in natural} == {1}
    none = d.where("false")
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [r.copies for r in mixing.mix(silent).collect()] == [1, 1]
