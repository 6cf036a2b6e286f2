import pytest

from docweave.operators.chunking import Chunking, chunk_documents, chunk_markdown, pack, split_paragraphs, split_sections

ROWS = "\n".join(f"| {i} | {'y' * 20} |" for i in range(100))
TABLE = f"| a | b |\n|---|---|\n{ROWS}"


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (TABLE, 1),
        (TABLE.replace("| 50 |", "\n| 50 |"), 1),
        ("| a |\n|---|\n| 1 |\n| 2 |", 1),
        ("| a |\n|---|\n| 1 |\n\nprose", 2),
        ("````\n```\nx\n\ny\n````\n\nprose", 2),
        ("```\na\n\nb\n```\n\nprose", 2),
        ("```\na\n\nb\n````\n\nprose", 2),
        ("```\n| a |\n|---|\n\n| 1 |\n```\n\nprose", 2),
        ("", 0),
    ],
)
def test_paragraphs(text, n):
    assert len(split_paragraphs(text)) == n


def test_table_stays_in_one_chunk():
    rows = "\n".join(f"| row{i} | {'z' * 20} |" for i in range(120))
    pieces = chunk_markdown(f"# T\n\n## Section\n\n| a | b |\n|---|---|\n{rows}\n\ntail")
    assert sum(all(f"row{i} " in p.text for i in range(120)) for p in pieces) == 1


@pytest.mark.parametrize(("n", "most", "overlap"), [(40, 400, 100), (40, 420, 120), (30, 400, 80)])
def test_packing_carries_overlap(n, most, overlap):
    text = "\n\n".join(f"para-{i}-" + "x" * 90 for i in range(n))
    got = pack(split_paragraphs(text), Chunking(max_size=most, overlap=overlap))
    assert all(len(t) <= most for t, _ in got)
    assert [o for _, o in got] == sorted({o for _, o in got})
    for (a, _), (b, _) in zip(got, got[1:], strict=False):
        assert a[-40:] in b


def test_overlap_modes_differ_at_zero():
    paragraphs = ["a" * 60, "b" * 60, "c" * 60]
    assert [t for t, _ in pack(paragraphs, Chunking(max_size=100, overlap=0))] == paragraphs
    assert len(pack(paragraphs, Chunking(max_size=100, overlap=0, overlap_mode="reference"))[-1][0]) > 60


def test_sections_and_paths():
    got = split_sections("# T\nintro\n## A\n### deep\nx\n## B\ny\n# U\nz\n## C\nw")
    assert [(s.heading, s.path) for s in got] == [("", ("T",)), ("A", ("T", "A")), ("B", ("T", "B")), ("U", ("U",)), ("C", ("U", "C"))]
    assert [s.offset for s in got] == [0, 10, 26, 33, 39]


def test_no_heading_and_blank():
    assert [(s.heading, s.path) for s in split_sections("just\n\ntext")] == [("", ())]
    assert chunk_markdown(" \n ") == []


def test_last_title_wins():
    assert split_sections("# A\n# B\ntext")[0].path == ("B",)


def test_chunk_documents(spark):
    df = spark.createDataFrame([("c", "/a.md", "# T\r\n\r\n## S\r\nbody"), ("c", "/b.md", None)], "corpus string, source_path string, markdown string")
    rows = chunk_documents(df).orderBy("pos").collect()
    assert [(r.heading, r.heading_path, r.pos) for r in rows] == [("", ["T"], 0), ("S", ["T", "S"], 1)]
    assert rows[1].section_id != rows[0].section_id and rows[1].char_offset == 5
