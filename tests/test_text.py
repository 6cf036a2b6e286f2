import hashlib

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("label", "bare"), [("1", True), ("10", True), ("5.2", True), ("5.10.3", True), ("A.1", True), ("Chapter 5", True), ("Section 3.1", True), ("1 Introduction", False), ("A", False), ("Some prose", False)])
def test_bare_labels(spark, label, bare):
    assert one(spark, X.is_bare_label(F.col("t")), t=label) is bare


@pytest.mark.parametrize(("raw", "want"), [("Decision- Making", "Decision-Making"), ("Consolidation - Close", "Consolidation - Close")])
def test_hyphens(spark, raw, want):
    assert one(spark, X.join_hyphenated(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("# x.py", "\\# x.py"), ("#hashtag", "#hashtag"), ("mid # hash", "mid # hash"), ("###### a", "\\###### a")])
def test_heading_marks(spark, raw, want):
    assert one(spark, X.escape_heading_marks(F.col("t")), t=raw) == want


def test_ids(spark):
    want = hashlib.sha256(b"/a.md:Head:7").hexdigest()[:16]
    assert one(spark, X.chunk_id(F.col("p"), F.col("h"), F.col("o")), p="/a.md", h="Head", o=7) == want
    assert one(spark, X.section_id(F.col("p"), F.col("h")), p="/a.md", h=["T", "S"]) == hashlib.sha256(b"/a.md:S").hexdigest()[:16]
    assert one(spark, X.section_id(F.col("p"), F.col("h")), p="/a.md", h=[]) == "unstructured:" + hashlib.sha256(b"/a.md").hexdigest()[:16]
    corpus, key = X.split_public_id(F.col("t"))
    assert one(spark, F.concat_ws("|", corpus, key), t="a:b:c1") == "a:b|c1"


def test_embedding_text(spark):
    assert one(spark, X.embedding_text(F.col("h"), F.col("t"), 3), h="  Head ", t="abcdef") == "Head\nabc"
    assert one(spark, X.embedding_text(F.col("h"), F.col("t"), 3), h="  ", t="abcdef") == "abc"


def test_summary_falls_back_to_two_lines(spark):
    assert one(spark, X.summary(F.col("h"), F.col("t")), h=" ", t="\n\n a \n\n b\nc") == "a b"
    assert one(spark, X.summary(F.col("h"), F.col("t")), h="h" * 300, t="x") == "h" * 200


def test_tokens_drop_stop_words_and_single_letters(spark):
    assert one(spark, X.tokens(F.col("t")), t="The Über-cat is a 4x4 x naïve") == ["über", "cat", "4x4", "naïve"]


def test_hashed_embedding_equals_the_python_one(spark):
    from docweave.plans.embed import hashed

    got = one(spark, X.hashed_embedding(F.col("t"), 16), t="alpha beta beta gamma")
    assert got == pytest.approx(hashed(["alpha beta beta gamma"], 16)[0].tolist())
    assert one(spark, X.hashed_embedding(F.col("t"), 4), t="") == [0, 0, 0, 0]
