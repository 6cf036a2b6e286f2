"""Command line over the engine: python -m docweave.cli --config CONFIG COMMAND ..., an answer as JSON."""

from __future__ import annotations

import argparse
import json
import os
from typing import Any

from .config import Config
from .plans.engine import SEARCH, Engine
from .session import session

#: Each tool's command.
COMMANDS = {tool: tool.replace("_", "-") for tool in Engine.TOOLS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweave", description=__doc__)
    p.add_argument("--config", "-c", default=os.environ.get("DOCWEAVE_CONFIG", "docweave.yaml"))
    p.add_argument("--master", help="Spark master, where the environment gives none")
    commands = p.add_subparsers(dest="command", required=True)

    def add(tool: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(COMMANDS[tool], help=text)

    c = add("search", "search the indexed corpora")
    c.add_argument("query")
    c.add_argument("--top-k", type=int)
    c.add_argument("--corpora", type=lambda s: [x for x in s.split(",") if x], help="names, by commas")
    c.add_argument("--hybrid", action=argparse.BooleanOptionalAction)
    c.add_argument("--return-mode", choices=["chunks", "documents", "auto"])
    c.add_argument("--max-chars", type=int)
    c.add_argument("--section-mode", action="store_true", default=None)
    c.add_argument("--section-filter")
    c.add_argument("--dedup-sections", action="store_true", default=None)
    c.add_argument("--max-distance", type=float)
    c = add("index", "bring the index up to the files")
    c.add_argument("corpus", nargs="?")
    c.add_argument("--force", action="store_true", default=None)
    add("status", "counts by corpus")
    c = add("get_chunk", "a chunk by its id")
    c.add_argument("chunk_id")
    c = add("get_document", "a document's text")
    c.add_argument("--corpus", required=True)
    c.add_argument("--path", required=True, dest="source_path")
    c = add("list_documents", "documents with their sizes and chunks")
    c.add_argument("corpus", nargs="?")
    add("list_folders", "corpora that accept uploads")
    c = add("get_toc", "a table of contents")
    c.add_argument("--corpus", required=True)
    c.add_argument("--document")
    c = add("upload", "put a local file into a corpus")
    c.add_argument("file")
    c.add_argument("--corpus", required=True)
    c = add("delete", "delete a file of a corpus")
    c.add_argument("filename")
    c.add_argument("--corpus", required=True)
    c = commands.add_parser("call", help="any tool by name, with its arguments as JSON")
    c.add_argument("tool", choices=Engine.TOOLS)
    c.add_argument("arguments", nargs="?", default="{}", type=json.loads)
    return p


def request(a: argparse.Namespace) -> tuple[str, dict[str, Any]]:
    """The tool that a command line names, and its arguments: only those that were given."""
    if a.command == "call":
        return a.tool, a.arguments
    tool = next(t for t, c in COMMANDS.items() if c == a.command)
    given = {k: v for k, v in vars(a).items() if k not in ("command", "config", "master") and v is not None}
    if tool == "upload":
        path = given.pop("file")
        with open(path, "rb") as f:
            given |= {"filename": os.path.basename(path), "content": f.read()}
    return tool, given


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    tool, arguments = request(a)
    out = Engine(session(a.master), Config.from_yaml(a.config)).call(tool, arguments)
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return int(isinstance(out, dict) and "error" in out)


def parity() -> dict[str, tuple[list[str], list[str]]]:
    """Of each tool, its arguments and what its command takes (a file stands for name and content)."""
    commands = next(x for x in parser()._actions if isinstance(x, argparse._SubParsersAction)).choices
    out = {}
    for tool, command in COMMANDS.items():
        taken = {x.dest for x in commands[command]._actions} - {"help"}
        if "file" in taken:
            taken = taken - {"file"} | {"filename", "content"}
        out[tool] = (sorted(SEARCH) if tool == "search" else Engine.arguments(tool), sorted(taken))
    return out


if __name__ == "__main__":
    raise SystemExit(main())
