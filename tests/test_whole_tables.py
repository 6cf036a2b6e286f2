"""Queries over whole tables against brute force."""

import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import pytest

from docweave.functions import text as X
from docweave.queries import QUERIES, SQL
from docweave.sources.convert import convert_pages

SF = os.environ.get("DOCWEAVE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_markdown_of_every_order(spark, db):
    got = QUERIES["pdf_markdown"](spark, SF).toPandas()
    assert sorted(got.doc.astype(int)) == [r[0] for r in db.execute("SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1").fetchall()]
    assert (got.markdown_sha.notna() == got.valid).all()


def test_postings_of_every_term(spark, db):
    got = QUERIES["bm25_postings"](spark, SF).toPandas()
    brute = Counter()
    for doc, t in db.execute("SELECT doc_id, text FROM documents").fetchall():
        brute.update((doc, w) for w in re.findall(r"\w{2,}", t.lower()) if w not in X.STOP_WORDS)
    assert {(r.doc_id, r.term): r.tf for r in got.itertuples()} == brute


def test_embedding_of_every_document(spark, db):
    got = {r.doc_id: r.embedding for r in QUERIES["hash_embed_documents"](spark, SF).collect()}
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got.keys() == texts.keys()
    for doc, t in texts.items():
        want = [0.0] * 64
        for w in re.findall(r"\w{2,}", (t or "").lower()):
            h = hashlib.sha256(w.encode()).hexdigest()
            want[int(h[:8], 16) % 64] += 1 if int(h[8], 16) < 8 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert got[doc] == pytest.approx([x / norm for x in want], abs=1e-6)


PAGE = """<html><head><title>no</title><style>p {}</style></head><body><h1>Top</h1><p>Some <b>bold</b> and
<a href="/x">a link</a> &amp; more.</p><ul><li>one</li><li>two <code>f()</code></li></ul><pre>a  =  1
b</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script></body></html>"""
MARKDOWN = "# Top\n\nSome **bold** and [a link](/x) & more.\n\n- one\n- two `f()`\n\n```\na  =  1\nb\n```\n\n| k | v |\n|---|---|\n| 1 | 2 |"


def test_digest_of_whole_pages(spark, tmp_path):
    pages = [(1, "u", PAGE), (2, "u", PAGE.replace("two", "three")), (3, "u", ""), (4, "u", None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.n_chars, r.markdown_sha) for r in QUERIES["html_to_markdown_digest"](spark, str(tmp_path)).collect()}
    want = {1: MARKDOWN, 2: MARKDOWN.replace("two", "three"), 3: "", 4: ""}
    assert got == {i: (len(m), hashlib.sha256(m.encode()).hexdigest()) for i, m in want.items()}


def test_digest_of_every_page(spark, db):
    got = [r.page_id for r in QUERIES["html_to_markdown_digest"](spark, SF).orderBy("page_id").collect()]
    assert got == [r[0] for r in db.execute(f"SELECT page_id FROM '{SF}/pages.parquet' ORDER BY 1").fetchall()]


HEADINGS = [
    (1, "<h1>r &amp;amp; &lt;b&gt; &amp;&amp</h1>"),  # cut within a reference
    (2, "<h1>token = &quot;0b96&quot;</h1>"),  # a reference that SQL doesn't decode
    (3, "<h1>&nbsp;it&#39;s &copy &amp;quot;</h1><p>&quot;"),
    (4, "<h1>a <b>b</b> <a href='/x?a=1&amp;b'>c</a>, <code>d</code><br>e<!-- no --></h1>"),
    (5, "<h1></h1><h1>second</h1>"),
    (6, "<p># no</p><h1 class='x'>\n a \t b\xa0? \n</h1>"),
    (7, "<p># no</p>"),
    (8, "<h1>open"),
    (9, "<H1>capital</H1><h1>small</h1>"),
    (10, "<head><p>no end<h1>head</h1>"),
    (11, ""),
    (12, None),
]


def test_titles_of_odd_pages_by_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", h) for i, h in HEADINGS], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(con.execute(SQL["html_to_markdown"]).fetchall())
    assert want[1] == "r &amp; <b> &&amp" and want[2] == "token = &quot;0b96&quot;"
    assert {r.page_id: r.title for r in QUERIES["html_to_markdown"](spark, str(tmp_path)).collect()} == want


def test_titles_are_headings_of_the_markdown(spark):
    """The operator by itself decodes all references, in the title as in the text."""
    got = convert_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert got and all(r.title and f"# {r.title}" in r.markdown.split("\n") for r in got)
    pages = spark.createDataFrame([(1, "u", "<H1>a &quot;b&quot; <i>&copy;</i></H1>")], "page_id bigint, url string, html string")
    assert [(r.title, r.markdown) for r in convert_pages(pages).collect()] == [('a "b" ©', '# a "b" *©*')]
