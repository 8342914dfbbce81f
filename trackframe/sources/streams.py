"""Byte streams cut into blocks that many tasks read: ordered scans of lines.

A stream is one file, or the files of a folder one after the other in the order of their names. It is cut at fixed offsets, whatever lies
there. A first pass counts what begins in each block (and hashes the block's bytes); a prefix sum over the blocks, a small table, gives
each block the number of what comes before; a second pass reads blocks again and numbers its own. A line belongs to the block it begins in.
No task holds more than a block and the rest of one line, and what a file's ordinals are doesn't depend on blocks or tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 8 << 20
#: What is read at once past a block's end.
MORE = 64 << 10
BLOCKS_DDL = "stream string, size long, block long, start long, n long"


@functools.lru_cache(maxsize=64)
def _store(scheme: str):
    return fs.LocalFileSystem() if scheme in ("", "file") else None


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    scheme, found, path = uri.partition(":")
    local = _store(scheme if found else "")
    if local is None:
        return fs.FileSystem.from_uri(uri)
    return local, ("/" + path.lstrip("/")) if found else uri


@dataclass(frozen=True)
class Stream:
    """parts: (address, offset of its first byte, bytes) in order."""

    name: str
    parts: tuple[tuple[str, int, int], ...]

    @property
    def size(self) -> int:
        return self.parts[-1][1] + self.parts[-1][2] if self.parts else 0

    def read(self, at: int, n: int) -> bytes:
        """Bytes at .. at + n, fewer at the end of the stream."""
        end, out = min(at + n, self.size), []
        for address, first, size in self.parts:
            a, b = max(at, first), min(end, first + size)
            if a < b:
                system, path = store(address)
                with system.open_input_file(path) as f:
                    got = f.read_at(b - a, a - first)
                if len(got) < b - a:
                    raise OSError(f"{address} has fewer bytes than when it was listed")
                out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)


def streams(path: str, together: bool = False) -> list[Stream]:
    """The files at a path (a file or a folder), each a stream; together: all of them one stream, in order of their names.
    Names that begin with a dot or an underscore are left out, as Spark does."""
    system, root = store(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or f.base_name[0] not in "._"))
    scheme = path.partition(":")[0] + "://" if ":" in path else ""
    if not together:
        return [Stream(scheme + p, ((scheme + p, 0, n),)) for p, n in files]
    parts, at = [], 0
    for p, n in files:
        parts.append((scheme + p, at, n))
        at += n
    return [Stream(path, tuple(parts))]


def blocks(spark: SparkSession, of: list[Stream], block: int = BLOCK) -> DataFrame:
    """A row for each block: stream, size, block, start, n."""
    s = spark.createDataFrame([(x.name, x.size) for x in of], "stream string, size long").where("size > 0")
    s = s.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block).cast("long"))))
    s = s.withColumn("start", F.col("block") * block)
    return s.withColumn("n", F.least(F.lit(block).cast("long"), F.col("size") - F.col("start")))


def width(spark: SparkSession, of: list[Stream], block: int) -> int:
    """Tasks for a pass over blocks: a block each, up to a few waves of them."""
    return max(1, min(sum(-(-s.size // block) for s in of), 16 * spark.sparkContext.defaultParallelism))


def each(of: list[Stream], work):
    """mapInArrow function: ``work(stream, row)`` yields record batches for each row of blocks()."""
    known = {s.name: s for s in of if [p[0] for p in s.parts] != [s.name]}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                name = row["stream"]
                yield from work(known.get(name) or Stream(name, ((name, 0, row["size"]),)), row)

    return run


def _begins(stream: Stream, row: dict) -> tuple[bytes, np.ndarray]:
    """A block's bytes, and where in it lines begin."""
    start, n = row["start"], row["n"]
    before = 1 if start else 0
    raw = stream.read(start - before, n + before)
    at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8)[: n + before - 1] == 10) + 1 - before
    return raw[before:], at if start else np.append(0, at)


def _counting(stream: Stream, row: dict):
    raw, at = _begins(stream, row)
    yield pa.RecordBatch.from_pylist([row | {"lines": len(at), "sha256": hashlib.sha256(raw).hexdigest()}], schema=_COUNTED)


_COUNTED = pa.schema([("stream", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("lines", pa.int64()), ("sha256", pa.string())])
_LINES = pa.schema([("stream", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("value", pa.binary())])


def counted(spark: SparkSession, of: list[Stream], block: int = BLOCK) -> DataFrame:
    """blocks() with lines (that begin in the block) and sha256 (of its bytes)."""
    b = blocks(spark, of, block).repartition(width(spark, of, block), "stream", "block")
    return b.mapInArrow(each(of, _counting), BLOCKS_DDL + ", lines long, sha256 string")


def _numbering(max_length: int):
    def work(stream: Stream, row: dict):
        raw, at = _begins(stream, row)
        if not len(at):
            return
        # the last line may go on in later blocks; of a line that is too long no more than that is read
        end, last = row["start"] + row["n"], int(at[-1])
        while raw[-1] != 10 and end < stream.size and len(raw) - last <= max_length + 2:
            more = stream.read(end, MORE)
            cut = more.find(b"\n") + 1
            raw += more[:cut] if cut else more
            end += len(more)
            if cut:
                break
        ends = np.append(at[1:], len(raw)).tolist()
        values = []
        for a, b in zip(at.tolist(), ends):
            to = b - 1 if raw[b - 1] == 10 else b
            to -= to > a and raw[to - 1] == 13
            values.append(raw[a:to] if to - a <= max_length else None)
        n = len(values)
        first = row["before"]
        size = np.array(ends) - at
        if values[-1] is None:
            size[-1] = -1 if raw[-1] != 10 and row["start"] + len(raw) < stream.size else size[-1]
        sizes = pa.array(size, mask=size < 0)
        for i in range(0, n, 4096):
            own = slice(i, min(n, i + 4096))
            yield pa.record_batch([pa.array([stream.name] * (own.stop - i)), pa.array(np.arange(first + i, first + own.stop)), pa.array(row["start"] + at[own]), sizes[own], pa.array(values[own], pa.binary())], schema=_LINES)

    return work


def lines(spark: SparkSession, of: list[Stream], block: int = BLOCK, max_length: int = 1 << 20, seen: DataFrame | None = None) -> DataFrame:
    """Every line: stream, ordinal (from 0), offset (of its first byte), n_bytes (with its end) and value (without it, as bytes; an end is a line
    feed, with a carriage return before it or not).

    A line of over max_length bytes has a null value, and a null n_bytes where its end is in another block. seen: counted() of the same streams and block, where a
    caller has it already."""
    by = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = counted(spark, of, block) if seen is None else seen
    seen = seen.withColumn("before", F.coalesce(F.sum("lines").over(by), F.lit(0)))
    seen = seen.where("lines > 0").repartition(width(spark, of, block), "stream", "block")
    return seen.mapInArrow(each(of, _numbering(max_length)), "stream string, ordinal long, offset long, n_bytes long, value binary")
