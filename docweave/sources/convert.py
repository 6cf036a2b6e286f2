"""File contents into markdown, in an Arrow map; errors are a column, not a failure."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from .office import docx_to_markdown, markdown_table, pptx_to_markdown, xlsx_to_markdown

TEXT = (".md", ".txt", ".markdown")
#: Formats that need a converter handed in: no library for them is a requirement.
PLUGGABLE = (".pdf", ".doc", ".ppt", ".xls")
OFFICE = {".docx": docx_to_markdown, ".xlsx": xlsx_to_markdown, ".pptx": pptx_to_markdown}


class _Markdown(HTMLParser):
    """HTML into markdown: headings, paragraphs, lists, links, emphasis, code, tables."""

    _BLOCK = frozenset("p div section article header footer main ul ol table tr blockquote pre br hr dl dt dd figure form nav aside".split())
    _SKIP = frozenset("script style head template noscript svg".split())
    _MARK = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = 0
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.title: list[str] = []
        self.titling: bool | None = None  # the first level-1 heading: not met, open or closed

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self._SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            if tag == "h1" and self.titling is None:
                self.titling = True
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n")
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            if n is not None:
                self.lists[-1] = n + 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{n + 1}. " if n is not None else "- "))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "tr":
            self.row = []
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
            if self.row is not None:
                self.row.append(tag)
        elif tag in self._MARK and not self.pre:
            self.out.append(self._MARK[tag])
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag in self._BLOCK:
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
            if tag == "h1" and self.titling:
                self.titling = False
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr" and self.row is not None:
            self.out.append("|")
            if not self.rows:
                self.out.append("\n" + "|---" * len(self.row) + "|")
            self.rows += 1
            self.row = None
        elif tag in self._MARK and not self.pre:
            self.out.append(self._MARK[tag])
        elif tag in self._BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.titling:
            self.title.append(data)
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


#: Unicode's space separators.
_BLANK = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def html_to_title_and_markdown(text: str) -> tuple[str, str]:
    """The plain text of the first level-1 heading, empty where there is none or it isn't closed, and the markdown."""
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    title = "" if parser.titling else re.sub(r"[ \t\n\f\r]+", " ", "".join(parser.title)).strip(_BLANK)
    lines = [line.rstrip() if line.startswith("  ") else line.strip() for line in "".join(parser.out).split("\n")]
    return title, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_to_markdown(text: str) -> str:
    return html_to_title_and_markdown(text)[1]


def csv_to_markdown(text: str) -> str:
    return markdown_table(list(csv.reader(io.StringIO(text))))


def _zip_to_markdown(raw: bytes, convert: Callable[[str, bytes], str]) -> str:
    parts = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(n for n in z.namelist() if not n.endswith("/")):
            try:
                parts.append(f"## File: {name}\n\n{convert(name, z.read(name))}")
            except ValueError:
                continue
    return "\n\n".join(parts)


def convert(name: str, raw: bytes, plugins: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Markdown of one file by its suffix; undecodable bytes become U+FFFD."""
    dot = name.rsplit("/", 1)[-1].rfind(".")
    ext = name.rsplit("/", 1)[-1][dot:].lower() if dot > 0 else ""
    if plugins and ext in plugins:
        return plugins[ext](raw)
    if ext in TEXT:
        return raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    if ext in OFFICE:
        return OFFICE[ext](raw)
    if ext in PLUGGABLE:
        raise ValueError(f"No converter for {ext} files was handed in")
    text = raw.decode("utf-8", "replace")
    if ext in (".html", ".htm"):
        return html_to_markdown(text)
    if ext == ".csv":
        return csv_to_markdown(text)
    if ext == ".json":
        return "```json\n" + json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n```"
    if ext == ".xml":
        return html.unescape(re.sub(r"\s*\n\s*", "\n", re.sub(r"<[^>]+>", "\n", text))).strip()
    if ext == ".zip":
        return _zip_to_markdown(raw, lambda n, b: convert(n, b, plugins))
    raise ValueError(f"Unsupported file extension: {ext}")


def convert_files(files: DataFrame, plugins: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files`` without content, with markdown and error (one of them null)."""
    keep = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, raw in zip(b.column("source_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    texts.append(convert(path, raw or b"", plugins))
                    errors.append(None)
                except Exception as e:  # one bad file mustn't end the run
                    texts.append(None)
                    errors.append(str(e)[:300])
            left = b.select(keep)
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*keep, "markdown", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    return files.mapInArrow(run, f"{schema}, markdown string, error string")


SPANS = "corpus string, source_path string, page int, block int, block_type int, line int, span int, text string, size double, error string"


def pdf_spans(files: DataFrame, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Text spans of (corpus, source_path, content): ``extract`` gives (page, block, block_type, line,
    span, text, size) of a file's bytes; its error is a row with nothing else."""
    schema = pa.schema([("corpus", pa.string()), ("source_path", pa.string())] + [(n, pa.int32()) for n in ("page", "block", "block_type", "line", "span")] + [("text", pa.string()), ("size", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for corpus, path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows = [(corpus, path, *span, None) for span in extract(raw or b"")]
                except Exception as e:  # one bad file mustn't end the run
                    rows = [(corpus, path, *[None] * 7, str(e)[:300])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("corpus", "source_path", "content").mapInArrow(run, SPANS)


def pdf_markdown(files: DataFrame, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(corpus, source_path, markdown) of PDF files by their font sizes; null markdown where there is no
    text, no heading size, an unlikely heading tree or an error: there another converter takes over."""
    doc = F.to_json(F.struct("corpus", "source_path"))
    spans = pdf_spans(files, extract).where("error is null").withColumn("doc", doc)
    made = layout.to_markdown(spans).select("doc", "markdown")
    named = files.select("corpus", "source_path", doc.alias("doc"))
    return named.join(made, "doc", "left").select("corpus", "source_path", "markdown")


def convert_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, markdown) of raw web pages; a null page has a null title and empty markdown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, "") if h is None else html_to_title_and_markdown(h) for h in b.column(2).to_pylist()]
            titles, texts = (pa.array([m[i] for m in made], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), titles, texts], names=["page_id", "url", "title", "markdown"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, title string, markdown string")
