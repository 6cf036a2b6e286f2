"""The registered queries and the pipeline over the smallest tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_sets, brute_tokens

import corpus_pipeline
from docweave.llm import common, mixing
from docweave.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("DOCWEAVE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    for c, kind in COLUMNS.get(name, {}).items():
        assert dict(df.dtypes)[c] == kind
    got = df.toPandas()
    if name not in ("op2_packing", "op7_topk_search"):
        assert sorted(got.doc_id) == [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.execute(ORACLE_SQL[name]).df()[list(got.columns)]
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_token_queries_agree(spark):
    import zlib

    docs = {r.doc_id: brute_tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in QUERIES["op5_token_output"](spark, SF).orderBy("doc_id").collect():
        ids = np.array(docs[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for r in QUERIES["op2_packing"](spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = common.materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
            after = [(r.doc_id, r.text) for r in out.collect()]
            assert set(after) <= set(before)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert sum(labels.get(i) == 0 for i in gone) <= 2
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[t] = max(i, best.get(t, i))
            assert sorted(after) == sorted((i, t) for t, i in best.items())
        elif name == "ngram_jaccard":
            keep = set(brute_components(brute_sets(before)))
            assert sorted(i for i, _ in after) == sorted(keep)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs, entropy_share=0.99, max_repeats=4.0).collect()}
            assert Counter(i for i, _ in after) == Counter({i: n for i, n in copies.items() if n})
        else:
            pieces = Counter()
            for r in out.collect():
                pieces[r.doc_id] += r.length
            assert pieces == Counter({i: n * len(brute_tokens(t)) for (i, t), n in Counter(before).items()})
        docs = out


def test_scratch_tables_are_released(spark):
    common.materialize(spark.range(3).withColumn("x", F.lit(1)), "x")
    assert common.release(spark) > 0 and common.release(spark) == 0
