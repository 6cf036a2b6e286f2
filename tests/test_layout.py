import pytest

from docweave.operators import layout as L


def tree(spark, levels, sizes=None):
    h = spark.createDataFrame([("d", 0, 0, i, v, 0.0, f"h{i}") for i, v in enumerate(levels)], "doc string, page int, block int, line int, level int, size double, text string")
    sizes = sizes or {1: 30.0, 2: 24.0, 3: 20.0, 4: 16.0, 5: 13.0, 6: 11.0}
    m = spark.createDataFrame([("d", s, v) for v, s in sizes.items()], "doc string, size double, level int")
    return L.validate_headings(h, m).first()


@pytest.mark.parametrize(
    ("levels", "valid"),
    [([1, 1, 1], False), ([1, 2, 2, 2], True), ([1, 2, 2, 2, 3], False), ([1, 2, 3, 4, 5, 2, 3, 4, 5] * 3, True), ([1] * 20 + [6] * 40, False), ([4, 1, 2], False), ([6, 1, 2], False), ([1, 5, 4, 2, 3], True), ([], True)],
)
def test_heading_trees(spark, levels, valid):
    assert tree(spark, levels).valid is valid


def test_close_sizes_fail(spark):
    assert tree(spark, [1, 2, 2], {1: 20.0, 2: 19.2}).reasons == ["clustering"]


def span(block, line, text, size, page=0):
    return ("d", page, block, 0, line, 0, text, size)


def markdown(spark, spans):
    df = spark.createDataFrame(spans, "doc string, page int, block int, block_type int, line int, span int, text string, size double")
    return L.to_markdown(df).first()


BODY = [span(9 + i, 0, "body text " * 20, 10.0) for i in range(3)]


def test_wrapped_title_and_label(spark):
    got = markdown(spark, [span(0, 0, "A long", 30.0), span(0, 1, "title", 30.0), span(1, 0, "5.2", 24.0), span(1, 1, "Decision-", 20.0), span(1, 2, "Making", 20.0), *BODY, span(20, 0, "Deep", 20.0)])
    assert got.markdown.startswith("# A long title\n") and "\n## 5.2 Decision-Making\n" in got.markdown


def test_label_in_its_own_block(spark):
    got = markdown(spark, [span(0, 0, "Title", 30.0), span(1, 0, "10", 24.0), span(2, 0, "Chapter name", 20.0), *BODY, span(20, 0, "Deep", 20.0)])
    assert "\n## 10 Chapter name\n" in got.markdown


def test_body_marks_are_escaped_and_uniform_text_falls_back(spark):
    got = markdown(spark, [span(0, 0, "Title", 30.0), span(1, 0, "Sect", 24.0), *BODY, span(20, 0, "# befExport.py is a comment", 10.0)])
    assert "\\# befExport.py" in got.markdown
    assert markdown(spark, BODY).markdown is None
