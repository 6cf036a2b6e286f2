"""Markdown into chunks: sections by headings, atomic tables and code fences, packing with overlap.

The states of a document's lines don't fit window expressions well, and a document is the unit of
everything here, so the work is done in one Arrow map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed patterns of the data model.
TABLE = re.compile(r"(\|[^\n]+\|\n\|[\s\-:|]+\|\n(?:\|[^\n]+\|\n?)*)", re.MULTILINE)
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
FENCE = re.compile(r"^(`{3,}|~{3,})")
SEPARATOR = re.compile(r"\|[\s\-:|]+\|")


@dataclass(frozen=True)
class Chunking:
    """``overlap_mode`` "clean": the end of the chunk before, once, at the start of a chunk, none for
    0. "reference": it stands before each paragraph of a chunk, one chunk late, and 0 carries all."""

    max_size: int = 2000
    overlap: int = 200
    table_aware: bool = True
    split_on_headings: bool = True
    overlap_mode: str = "clean"


class Section(NamedTuple):
    heading: str
    text: str
    offset: int
    path: tuple[str, ...]


class Piece(NamedTuple):
    heading: str
    text: str
    offset: int
    path: tuple[str, ...]


def split_sections(text: str) -> list[Section]:
    """Sections begin at level-2 headings, and at a level-1 heading once a level-2 one is open.

    The path holds the last title and the level-2 heading; deeper ones are content. What stands
    before the first section has no heading. Sections of white space are left out.
    """
    out: list[Section] = []
    title: str | None = None
    inside = False
    heading, start, path = "", 0, ()
    held: list[str] = []
    at = 0

    def close() -> None:
        body = "".join(held).strip()
        if body:
            out.append(Section(heading, body, start, path))
            held.clear()

    for line in text.split("\n"):
        m = HEADING.match(line)
        level = len(m[1]) if m else 0
        if level == 2:
            close()
            held.clear()
            heading, start, inside = m[2].strip(), at, True
            path = (title, heading) if title is not None else (heading,)
        elif level == 1:
            name = m[2].strip()
            if inside:
                close()
                heading, start = name, at
            title, path, inside = name, (name,), False
        held.append(line + "\n")
        at += len(line) + 1
    close()
    return out or [Section("", text.strip(), 0, ())]


def split_paragraphs(text: str) -> list[str]:
    """Runs of lines between blank lines; code fences and tables are never cut.

    A fence closes at a fence of its own character that is as long or longer. A table begins at a
    row with a separator below it, and a blank line inside is kept if a row follows.
    """
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    follows = [""] * (len(lines) + 1)  # the next line with something on it, after each
    for i in range(len(lines) - 1, -1, -1):
        follows[i] = bare[i] or follows[i + 1]
    out: list[str] = []
    held: list[str] = []
    fence, table = "", False
    for i, s in enumerate(bare):
        if m := FENCE.match(s):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = ""
        if not fence:
            row = s.startswith("|")
            if not table:
                table = row and i + 1 < len(lines) and bool(SEPARATOR.match(bare[i + 1]))
            elif not row:
                table = not s and follows[i + 1].startswith("|")
        if s or fence or table:
            held.append(lines[i])
        elif held:
            out.append("\n".join(held))
            held = []
    if held:
        out.append("\n".join(held))
    return out


def pack(paragraphs: list[str], how: Chunking) -> list[tuple[str, int]]:
    """(text, offset) of chunks filled with whole paragraphs; a longer paragraph is a chunk of its own.

    Offsets count from the first chunk's start and grow by each chunk's length and a blank line.
    """
    again = how.overlap_mode == "reference"  # the lead stands before each paragraph, not once a chunk
    out: list[tuple[str, int]] = []
    held: list[str] = []
    lead, size, at = "", 0, 0

    def close() -> str:
        """The chunk's text goes out; what of it may lead the next one."""
        nonlocal at
        text = "\n\n".join(held)
        out.append((text.strip() if again else text, at))
        first = 0 if again or not lead else len(lead) + 2  # a lead counts for the chunk it was taken from
        at += size - first + 2
        held.clear()
        return out[-1][0][first:]

    for p in filter(None, map(str.strip, paragraphs)):
        piece = f"{lead}\n\n{p}" if lead and (again or not held) else p
        if held and size + 2 + len(piece) > how.max_size:
            text = close()
            if again:
                lead = text[-how.overlap :] if 0 < how.overlap < len(text) else text
            else:
                room = min(how.overlap, how.max_size - len(p) - 2)
                lead = text[-room:] if room > 0 else ""
                piece = f"{lead}\n\n{p}" if lead else p
        size = size + 2 + len(piece) if held else len(piece)
        held.append(piece)
    if held:
        close()
    return out


def chunk_markdown(text: str, how: Chunking = Chunking()) -> list[Piece]:
    """A document's chunks in order. Offsets of sections count tables as their short stand-ins."""
    if not text or not text.strip():
        return []
    if not how.split_on_headings:
        return [Piece("", t, at, ()) for t, at in pack(split_paragraphs(text), how)]
    tables: list[str] = []

    def put_by(m: re.Match) -> str:
        tables.append(m[0])
        return f"__TABLE_{len(tables) - 1}__\n"

    out: list[Piece] = []
    for s in split_sections(TABLE.sub(put_by, text) if how.table_aware else text):
        body = re.sub(r"__TABLE_(\d+)__", lambda m: tables[int(m[1])] if int(m[1]) < len(tables) else m[0], s.text) if tables else s.text
        if len(body) <= how.max_size:
            out.append(Piece(s.heading, body.strip(), s.offset, s.path))
        else:
            out += [Piece(s.heading, t, s.offset + at, s.path) for t, at in pack(split_paragraphs(body), how)]
    return out


_PIECE = pa.schema([("corpus", pa.string()), ("source_path", pa.string()), ("pos", pa.int64()), ("heading", pa.string()), ("text", pa.string()), ("char_offset", pa.int64()), ("heading_path", pa.list_(pa.string()))])


def chunk_documents(documents: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """Chunks of (corpus, source_path, markdown), with ids, section ids, summaries and counts."""
    settings = replace(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (corpus, path, i, *piece)
                for corpus, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for i, piece in enumerate(chunk_markdown((text or "").replace("\r\n", "\n").replace("\r", "\n"), settings))
            ]
            if rows:
                corpus, path, pos, heading, body, offset, trail = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((corpus, path, pos, heading, body, offset, [list(t) for t in trail]), _PIECE, strict=True)], schema=_PIECE)

    made = documents.select("corpus", "source_path", "markdown").mapInArrow(run, "corpus string, source_path string, pos bigint, heading string, text string, char_offset bigint, heading_path array<string>")
    return made.select(
        "corpus",
        "source_path",
        "pos",
        X.chunk_id(F.col("source_path"), F.col("heading"), F.col("char_offset")).alias("chunk_id"),
        "heading",
        "text",
        "char_offset",
        F.length("text").cast("long").alias("char_count"),
        X.summary(F.col("heading"), F.col("text")).alias("summary"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        "heading_path",
        X.section_id(F.col("source_path"), F.col("heading_path")).alias("section_id"),
    )
