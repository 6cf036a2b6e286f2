"""Small files through Hadoop's file systems, wherever a path lies."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    size: int
    folder: bool


class Folder:
    """One folder. Names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        fs = self._path(self.root).getFileSystem(conf)
        # others may edit a local file later: no checksum of ours may stand beside it
        self._fs = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw() if fs.getUri().getScheme() == "file" else fs

    def at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def entry(self, name: str) -> Entry | None:
        if not self.exists(name):
            return None
        s = self._fs.getFileStatus(self.at(name))
        return Entry(s.getPath().getName(), s.getLen(), s.isDirectory())

    def listed(self, name: str = "") -> list[Entry]:
        if not self.exists(name):
            return []
        return [Entry(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(self.at(name))]

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Make a file that isn't there yet; False if it is."""
        try:
            out = self._fs.create(self.at(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise OSError(f"could not create {name}: {str(e)[:200]}") from e
        out.write(bytearray(data))
        out.close()
        return True

    def replace(self, name: str, data: bytes) -> None:
        """Write a file under another name first, then move it: readers see the old or the new one."""
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self.at(temp), True)
        out.write(bytearray(data))
        out.close()
        if not self.move(temp, name):
            self.delete(name)  # a file system that doesn't move onto an old file
            if not self.move(temp, name):
                self.delete(temp)
                raise OSError(f"could not move {name} into place")

    def move(self, old: str, new: str) -> bool:
        try:
            return bool(self._fs.rename(self.at(old), self.at(new)))
        except Exception:
            return False

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self.at(name), True))

    def make(self) -> None:
        self._fs.mkdirs(self.at())

    def modified(self, name: str) -> int:
        return int(self._fs.getFileStatus(self.at(name)).getModificationTime() // 1000)
