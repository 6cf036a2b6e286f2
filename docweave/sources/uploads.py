"""Uploading, fetching and deleting a corpus's files, wherever it lies, with their checks in a fixed order."""

from __future__ import annotations

import base64
import binascii
import mimetypes
from typing import Any

from pyspark.sql import SparkSession

from ..config import Config
from .paths import Folder


def list_folders(config: Config) -> dict[str, Any]:
    rows = [{"name": c.name, "path": c.path, "topic": c.topic, "extensions": c.extensions} for c in config.corpora if c.name in config.upload.allow]
    return {"folders": rows, "total": len(rows), "max_file_size": config.upload.max_file_size, "allowed_extensions": config.upload.allowed_extensions}


def decode(content: str) -> bytes:
    try:
        return base64.b64decode(content, validate=True)
    except (binascii.Error, ValueError) as e:
        raise ValueError("Invalid base64 content") from e


def _home(config: Config, corpus: str) -> str | None:
    return next((c.path.rstrip("/") for c in config.corpora if c.name == corpus), None)


def _base(name: str) -> str | None:
    """The last part of a name, under which alone a file may be stored; None if there is none."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1].strip()
    return None if base in ("", ".", "..") else base


def save(spark: SparkSession, config: Config, corpus: str, name: str, raw: bytes) -> dict[str, Any]:
    """Write a file into a corpus's folder: under a temporary name first, then moved."""
    up = config.upload
    if corpus not in up.allow:
        return {"error": f"Corpus '{corpus}' does not accept uploads"}
    if (home := _home(config, corpus)) is None:
        return {"error": f"corpus not found: {corpus}"}
    if (base := _base(name)) is None:
        return {"error": "Invalid filename"}
    ext = base[base.rindex(".") :].lower() if "." in base.lstrip(".") else ""
    if ext not in up.allowed_extensions:
        return {"error": f"Extension '{ext}' not allowed. Permitted: {sorted(up.allowed_extensions)}"}
    if len(raw) > up.max_file_size:
        return {"error": f"File too large ({len(raw)} bytes, max {up.max_file_size / (1024 * 1024):.0f}MB)"}
    try:
        folder = Folder(spark, home)
        folder.make()
        folder.replace(base, raw)
    except Exception:  # whatever the file system says, the caller gets an answer
        return {"error": f"Failed to save file: {base}"}
    return {"corpus": corpus, "filename": base, "path": f"{home}/{base}", "size_bytes": len(raw), "saved": True, "indexed": False}


def _found(spark: SparkSession, config: Config, corpus: str, name: str) -> dict[str, Any]:
    """The file of that name in a corpus's own folder: {"folder", "base", "size"}, or an error."""
    if (home := _home(config, corpus)) is None:
        return {"error": f"corpus not found: {corpus}"}
    if (base := _base(name)) is None:
        return {"error": "Invalid filename"}
    folder = Folder(spark, home)
    entry = folder.entry(base)
    if entry is None:
        return {"error": f"File not found: {base}"}
    if entry.folder:
        return {"error": f"Not a file: {base}"}
    return {"folder": folder, "base": base, "size": entry.size}


def delete(spark: SparkSession, config: Config, corpus: str, name: str) -> dict[str, Any]:
    if corpus not in config.upload.allow:
        return {"error": f"Corpus '{corpus}' does not accept uploads (delete not allowed)"}
    found = _found(spark, config, corpus, name)
    if "error" in found:
        return found
    base = found["base"]
    try:
        gone = found["folder"].delete(base)
    except Exception:
        gone = False
    if not gone:
        return {"error": f"Failed to delete file: {base}"}
    return {"corpus": corpus, "filename": base, "path": f"{found['folder'].root}/{base}", "size_bytes": found["size"], "deleted": True, "indexed": False}


def fetch(spark: SparkSession, config: Config, corpus: str, name: str) -> dict[str, Any]:
    """A file's bytes as they are, with their media type. Names that lead elsewhere are refused."""
    parts = name.replace("\\", "/").split("/")
    if ".." in parts or name.startswith("/") or len(parts) != 1:
        return {"error": "Invalid filename (path traversal detected)"}
    found = _found(spark, config, corpus, name)
    if "error" in found:
        return found
    kind = mimetypes.guess_type(found["base"])[0] or "application/octet-stream"
    return {"corpus": corpus, "filename": found["base"], "media_type": kind, "size_bytes": found["size"], "content": found["folder"].read(found["base"])}
