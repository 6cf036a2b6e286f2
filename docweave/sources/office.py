"""Office files of the XML kind (.docx, .xlsx, .pptx) into markdown: they are zip files of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

# Fixed namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def markdown_table(rows: list[list[str]]) -> str:
    """A table whose first row is its head; short rows are filled up."""
    rows = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _opened(raw: bytes, name: str) -> tuple[zipfile.ZipFile, ET.Element]:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("not an office file of the XML kind") from e
    root = _part(z, name)
    if root is None:
        raise ValueError(f"the file has no {name}")
    return z, root


def _run_text(p: ET.Element) -> str:
    """Text of a paragraph's runs, with tabs and line breaks."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{A}br": "\n"}
    return "".join(e.text or "" if e.tag in (f"{W}t", f"{A}t") else marks.get(e.tag, "") for e in p.iter()).strip()


def _word_paragraph(p: ET.Element) -> str:
    text = _run_text(p)
    style = p.find(f"{W}pPr/{W}pStyle")
    name = (style.get(f"{W}val") or "").lower() if style is not None else ""
    if text and (m := re.fullmatch(r"heading\s*([1-6])", name)):
        return "#" * int(m[1]) + " " + text.replace("\n", " ")
    if text and name == "title":
        return "# " + text.replace("\n", " ")
    return f"- {text}" if text and p.find(f"{W}pPr/{W}numPr") is not None else text


def docx_to_markdown(raw: bytes) -> str:
    """Headings by their styles, list items, tables and paragraphs in order."""
    _, root = _opened(raw, "word/document.xml")
    out: list[str] = []
    body = root.find(f"{W}body")
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            text = _word_paragraph(e)
            joined = out and text.startswith("- ") and out[-1].rsplit("\n", 1)[-1].startswith("- ")
            if joined:
                out[-1] += "\n" + text
            else:
                out.append(text)
        elif e.tag == f"{W}tbl":
            out.append(markdown_table([[" ".join(filter(None, map(_run_text, c.iter(f"{W}p")))) for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]))
    return "\n\n".join(filter(None, out))


def _column(reference: str) -> int:
    """A cell's column, from 0, of its reference (B7: 1)."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_rows(sheet: ET.Element, shared: list[str]) -> Iterator[list[str]]:
    for row in sheet.iter(f"{S}row"):
        cells: list[str] = []
        for c in row.findall(f"{S}c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            v, kind = c.find(f"{S}v"), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}[v.text] if kind == "b" else v.text
        if any(cells):
            yield cells


def xlsx_to_markdown(raw: bytes) -> str:
    """A section and a table for each sheet; values as they are stored."""
    z, book = _opened(raw, "xl/workbook.xml")
    strings = _part(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in strings.findall(f"{S}si")] if strings is not None else []
    links = _part(z, "xl/_rels/workbook.xml.rels")
    targets = {e.get("Id"): e.get("Target", "") for e in links} if links is not None else {}
    out = []
    for sheet in book.iter(f"{S}sheet"):
        target = targets.get(sheet.get(f"{R}id"), "")
        part = _part(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        table = markdown_table(list(_sheet_rows(part, shared))) if part is not None else ""
        out.append(f"## {sheet.get('name')}" + (f"\n\n{table}" if table else ""))
    return "\n\n".join(out)


def pptx_to_markdown(raw: bytes) -> str:
    """A section for each slide, with its title, and its paragraphs and tables."""
    z, _ = _opened(raw, "ppt/presentation.xml")
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        title, parts = "", []
        for shape in _part(z, name).iter():
            if shape.tag == f"{P}sp":
                text = "\n".join(filter(None, map(_run_text, shape.iter(f"{A}p"))))
                kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                    title = text.replace("\n", " ")
                elif text:
                    parts.append(text)
            elif shape.tag == f"{A}tbl":
                parts.append(markdown_table([[" ".join(filter(None, map(_run_text, c.iter(f"{A}p")))) for c in r.findall(f"{A}tc")] for r in shape.findall(f"{A}tr")]))
        out.append("\n\n".join([f"## Slide {number}" + (f": {title}" if title else ""), *filter(None, parts)]))
    return "\n\n".join(out)
