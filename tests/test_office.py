"""Office files, made by hand, into markdown."""

import io
import zipfile

import pytest

from docweave.sources.convert import convert

MAIN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SLIDE = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def paragraph(text, style="", listed=False):
    kind = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{kind}{'<w:numPr/>' if listed else ''}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word():
    cells = "".join(f"<w:tr>{''.join(f'<w:tc>{paragraph(c)}</w:tc>' for c in row)}</w:tr>" for row in (("k", "v"), ("a|b", "2")))
    body = paragraph("Report", "Title") + paragraph("Part", "Heading2") + paragraph("Some &amp; text") + paragraph("one", listed=True) + paragraph("two", listed=True) + paragraph("") + f"<w:tbl>{cells}</w:tbl>"
    raw = zipped(**{"word__document.xml": f"<w:document {MAIN}><w:body>{body}</w:body></w:document>"})
    assert convert("a.docx", raw) == "# Report\n\n## Part\n\nSome & text\n\n- one\n- two\n\n| k | v |\n|---|---|\n| a\\|b | 2 |"


def test_excel():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>z</t></is></c></row><row/><row><c r="A3"><v>1.5</v></c><c r="B3" t="b"><v>1</v></c><c r="AA3" t="str"><v>far</v></c></row>'
    raw = zipped(
        **{
            "xl__workbook.xml": f'<workbook {SHEET}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
            "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>',
            "xl__sharedStrings.xml": f"<sst {SHEET}><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
            "xl__worksheets__a.xml": f"<worksheet {SHEET}><sheetData>{rows}</sheetData></worksheet>",
            "xl__worksheets__b.xml": f"<worksheet {SHEET}><sheetData/></worksheet>",
        }
    )
    got = convert("a.xlsx", raw).split("\n")
    assert got[0] == "## One" and got[2].startswith("| name |  | z |") and got[4].startswith("| 1.5 | TRUE |") and got[4].endswith("| far |") and got[-1] == "## Two"


def test_powerpoint():
    def shape(text, kind=""):
        return f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\'{kind}\'/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    slides = {f"ppt__slides__slide{n}.xml": f"<p:sld {SLIDE}><p:cSld>{shape(f'Title {n}', 'title')}{shape('body')}</p:cSld></p:sld>" for n in (10, 2)}
    raw = zipped(**{"ppt__presentation.xml": f"<p:presentation {SLIDE}/>"}, **slides)
    assert convert("a.pptx", raw) == "## Slide 2: Title 2\n\nbody\n\n## Slide 10: Title 10\n\nbody"


def test_what_isnt_an_office_file():
    for name, raw, says in (("a.docx", b"x", "not an office file"), ("a.xlsx", zipped(x="y"), "no xl/workbook.xml"), ("a.doc", b"", "No converter for .doc"), ("a.pdf", b"", "No converter for .pdf")):
        with pytest.raises(ValueError, match=says):
            convert(name, raw)
    assert convert("a.doc", b"x", {".doc": lambda raw: "own"}) == "own"
