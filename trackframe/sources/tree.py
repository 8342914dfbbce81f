"""A directory tree as a data source: files, folders and links with their kind, size and streamed digest.

    spark.dataSource.register(TreeSource); spark.read.format("tree").option("partitions", 64).load(folder)

Links are named, never followed; empty files and folders are rows too. Folders are dealt to partitions, each of which walks its own; a file is
read in pieces. The tree must be in a folder that all machines see.
"""

from __future__ import annotations

import hashlib
import os
import stat
import unicodedata
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, raw binary, kind string, size long, sha256 string"
PIECE = 1 << 20


def entry(root: bytes, path: bytes) -> tuple:
    """One row. path: in normal form C, relative to the root; raw: the name as it is; sha256: of a file's bytes, or of what a link names."""
    full = os.path.join(root, path)
    info = os.lstat(full)
    name = unicodedata.normalize("NFC", path.decode("utf-8", "surrogateescape")).encode("utf-8", "replace").decode()
    if stat.S_ISLNK(info.st_mode):
        target = os.readlink(full)
        return name, path, "link", len(target), hashlib.sha256(target).hexdigest()
    if stat.S_ISDIR(info.st_mode):
        return name, path, "folder", None, None
    if not stat.S_ISREG(info.st_mode):
        return name, path, "other", None, None
    sha, size = hashlib.sha256(), 0
    with open(full, "rb") as f:
        while piece := f.read(PIECE):
            sha.update(piece)
            size += len(piece)
    if size != info.st_size:
        raise OSError(f"{name} changed while it was read")
    return name, path, "file", size, sha.hexdigest()


class _Part(InputPartition):
    """Entries by themselves, and folders with all that is below them."""

    def __init__(self, entries: list[bytes], below: list[bytes]):
        self.entries, self.below = entries, below


class TreeReader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.n = os.fsencode(root), partitions

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough of them to deal."""
        entries, folders = [], [b""]
        while folders and len(folders) + len(entries) // 256 < self.n:
            opened = []
            for f in folders:
                for e in sorted(os.scandir(os.path.join(self.root, f)), key=lambda e: e.name):
                    entries.append(os.path.join(f, e.name))
                    if e.is_dir(follow_symlinks=False):
                        opened.append(entries[-1])
            folders = opened
        n = max(1, min(self.n, len(entries) + len(folders)))
        return [_Part(entries[i::n], folders[i::n]) for i in range(n)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path in part.entries:
            yield entry(self.root, path)
        for folder in part.below:
            for at, folders, files in os.walk(os.path.join(self.root, folder), followlinks=False):
                here = os.path.relpath(at, self.root)
                for name in folders + files:  # links to folders are among the folders
                    yield entry(self.root, name if here == b"." else os.path.join(here, name))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://")
        return TreeReader(path, int(self.options.get("partitions", "64")))
