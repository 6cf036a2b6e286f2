from docweave.config import Corpus
from docweave.sources.convert import convert_files
from docweave.sources.files import scan


def test_scan_and_convert(spark, tmp_path):
    for d in ("a", "a/.git", "a/sub"):
        (tmp_path / d).mkdir()
    (tmp_path / "a" / "x.MD").write_bytes(b"# T\r\nbad \xff byte")
    (tmp_path / "a" / "sub" / "y.html").write_text("<h2>H</h2><script>no</script><p>yes &amp; more</p>")
    (tmp_path / "a" / "big.md").write_text("z" * 500)
    (tmp_path / "a" / "bad.json").write_text("{")
    (tmp_path / "a" / ".git" / "hidden.md").write_text("no")
    files = scan(spark, Corpus("c", str(tmp_path / "a"), extensions=["md", ".HTML", ".json"]), max_file_size=400, exclude_dirs=[".git"])
    got = {r.filename: r for r in convert_files(files).collect()}
    assert set(got) == {"x.MD", "y.html", "bad.json"}
    assert got["x.MD"].markdown == "# T\nbad � byte" and got["y.html"].markdown == "## H\n\nyes & more"
    assert got["bad.json"].markdown is None and got["bad.json"].error
    assert scan(spark, Corpus("c", str(tmp_path / "none"))).count() == 0
