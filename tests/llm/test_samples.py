"""Samples that models are fitted on hold every language and label."""

import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm import common, langid

IDS = [i for i in range(4000) if zlib.crc32(str(i).encode()) % common.FOLDS]
LIMIT = 100


def test_rare_languages_are_learned(spark):
    rare = {i: f"rare{k}" for k, i in enumerate(IDS[:2000:200])}
    d = spark.createDataFrame([(i, f"ab{i} cd", rare.get(i, "common")) for i in IDS[:2000]], "doc_id bigint, text string, lang string")
    assert set(langid.fit(d, max_documents=LIMIT).languages) == {"common", *rare.values()}
    n = common.stratified(d, F.col("doc_id"), "lang", LIMIT).count()
    assert 0.6 * LIMIT < n < 1.4 * LIMIT


@pytest.mark.parametrize("rare", [0, 1])
def test_rare_labels_are_drawn(spark, rare):
    d = spark.createDataFrame([(i, "x") for i in IDS[:2000]], "doc_id bigint, text string")
    plain = {r.doc_id for r in common.sampled(d, F.col("doc_id"), LIMIT).collect()}
    few = set([i for i in IDS[:2000] if i not in plain][:3])
    labels = spark.createDataFrame([(i, rare if i in few else 1 - rare) for i in IDS[:2000]], "doc_id bigint, toxic int")
    got = common.training_rows(d, labels, "toxic", LIMIT).groupBy("y").count().collect()
    n = {r.y: r["count"] for r in got}
    assert n[rare] >= 1 and 0.6 * LIMIT < sum(n.values()) < 1.4 * LIMIT


def test_common_values_keep_the_plain_sample(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in IDS], "doc_id bigint, lang string")
    ids = [sorted(r.doc_id for r in s.collect()) for s in (common.stratified(d, F.col("doc_id"), "lang", LIMIT), common.sampled(d, F.col("doc_id"), LIMIT))]
    assert ids[0] == ids[1]
    assert common.stratified(d, F.col("doc_id"), "lang", len(IDS)).count() == len(IDS)
