"""One large JSON document read by many tasks.

The document is a stream (streams.Stream) cut into blocks at fixed offsets. What a byte means depends on all before it, but only through
whether it is in a string, whether a backslash is pending, and the depth. A first pass computes, for each block and each state it may begin in, the state at
its end and the change of depth; composing those along the blocks (a small table) gives every block its true state. A second pass
then finds in each block where the elements of the wanted array begin, with a prefix sum for their ordinals; a third one cuts elements out
and leaves their parsing to Spark. An element belongs to the block its opening bracket or comma is in, and may end in a later one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import staged
from .streams import BLOCKS_DDL, MORE, Stream, blocks, each, width

BLOCK = 2 << 20
QUOTE, ESCAPE, COMMA = 34, 92, 44
#: States: outside of strings, inside, inside after a backslash.
OUT, IN, PENDING = 0, 1, 2
#: A member name of more bytes isn't looked for.
MAX_NAME = 4096


def _escaped(buf: np.ndarray, pending: bool) -> np.ndarray:
    """Which bytes a backslash takes: those after an odd number of backslashes. One more entry tells of the byte after the block."""
    n = len(buf)
    slash = buf == ESCAPE
    out = np.zeros(n + 1, dtype=bool)
    ends = np.flatnonzero(slash & ~np.append(slash[1:], False))
    starts = np.flatnonzero(slash & ~np.append(False, slash[:-1]))
    length = ends - starts + 1
    if pending and n:
        if slash[0]:
            length[0] += 1  # the run began before the block
        else:
            out[0] = True
    odd = length % 2 == 1
    out[ends[odd] + 1] = True
    return out


def _depths(buf: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(outside, change, state after): which bytes are outside of strings, the change of depth by each, and the state at the end."""
    taken = _escaped(buf, state == PENDING)
    quotes = (buf == QUOTE) & ~taken[:-1]
    inside = (np.cumsum(quotes) + (state != OUT)) % 2 == 1  # after each byte
    outside = ~inside & ~quotes
    change = np.where(outside, ((buf == 91) | (buf == 123)).astype(np.int8) - ((buf == 93) | (buf == 125)).astype(np.int8), np.int8(0))
    end = state if not len(buf) else (PENDING if taken[-1] else IN) if inside[-1] else OUT
    return outside, change, end


def _summarising(stream: Stream, row: dict):
    buf = np.frombuffer(stream.read(row["start"], row["n"]), dtype=np.uint8)
    found = [_depths(buf, s) for s in (OUT, IN, PENDING)]
    yield pa.record_batch([pa.array([row[c]]) for c in ("stream", "size", "block", "start", "n")] + [pa.array([[int(f[2]) for f in found]], pa.list_(pa.int32())), pa.array([[int(f[1].sum()) for f in found]])], names=_SUMMARY)


_SUMMARY = ["stream", "size", "block", "start", "n", "ends", "changes"]


def _composed(table: pa.Table) -> pa.Table:
    """The state and depth each block of one stream begins in."""
    table = table.sort_by("block")
    state, depth, states, depths = OUT, 0, [], []
    for ends, changes in zip(table.column("ends").to_pylist(), table.column("changes").to_pylist()):
        states.append(state)
        depths.append(depth)
        depth += changes[state]
        state = ends[state]
    t = table.select(_SUMMARY[:5])
    return t.append_column("state", pa.array(states, pa.int32())).append_column("depth", pa.array(depths, pa.int64()))


def index(spark: SparkSession, of: list[Stream], block: int = BLOCK) -> DataFrame:
    """blocks() with the state and the depth each one begins in."""
    b = blocks(spark, of, block).repartition(width(spark, of, block), "stream", "block")
    s = b.mapInArrow(each(of, _summarising), BLOCKS_DDL + ", ends array<int>, changes array<long>")
    return s.groupBy("stream").applyInArrow(_composed, BLOCKS_DDL + ", state int, depth long")


_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def _marks(stream: Stream, row: dict, name: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, places, kinds) of a block: where the wanted array opens (kind 1) or closes (-1), and the commas at its depth (0)."""
    level = 0 if name is None else 1  # depth outside of the array
    raw = stream.read(row["start"], row["n"])
    buf = np.frombuffer(raw, dtype=np.uint8)
    outside, change, _ = _depths(buf, row["state"])
    after = row["depth"] + np.cumsum(change, dtype=np.int64)
    opens = np.flatnonzero((buf == 91) & outside & (after == level + 1))
    closes = np.flatnonzero((buf == 93) & outside & (after == level))
    commas = np.flatnonzero((buf == COMMA) & outside & (after == level + 1))
    if name is not None:
        keep = []
        for p in opens.tolist():
            from_ = max(0, row["start"] + p - MAX_NAME)
            found = _NAME.search(stream.read(from_, row["start"] + p - from_))
            keep.append(found is not None and found[1] == name)
        # arrays of other members open and close too: kind 2
        kinds = np.where(keep, 1, 2) if len(opens) else opens
    else:
        kinds = np.ones(len(opens), dtype=np.int64)
    at = np.concatenate([opens, closes, commas])
    kind = np.concatenate([kinds, np.full(len(closes), -1), np.zeros(len(commas), np.int64)]).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return raw, at[order], kind[order]


def _inside(kind: np.ndarray, state: bool) -> np.ndarray:
    """Whether the wanted array is open after each mark."""
    turn = np.where(kind != 0, np.arange(len(kind)), -1)
    last = np.maximum.accumulate(turn) if len(kind) else turn
    return np.where(last >= 0, kind[np.maximum(last, 0)] == 1, state)


def _finding(name: bytes | None):
    def work(stream: Stream, row: dict):
        raw, at, kind = _marks(stream, row, name)
        turns = kind[kind != 0]
        n = [int(((kind == 1) | (kind == 0) & _inside(kind, s)).sum()) for s in (False, True)]
        yield pa.record_batch(
            [pa.array([row[c]]) for c in _SUMMARY[:5]] + [pa.array([row["state"]], pa.int32()), pa.array([row["depth"]])] + [pa.array([bool(turns[-1] == 1) if len(turns) else None], pa.bool_()), pa.array([n])],
            names=[*_SUMMARY[:5], "state", "depth", "open_after", "found"],
        )

    return work


def _cutting(name: bytes | None, max_bytes: int):
    def work(stream: Stream, row: dict):
        raw, at, kind = _marks(stream, row, name)
        was = row["open"]
        inside = _inside(kind, was)
        begins = np.flatnonzero((kind == 1) | (kind == 0) & inside)
        # an element ends at the next comma or closing bracket of its array
        rows, first = [], row["before"]
        for i, b in enumerate(begins.tolist()):
            a = int(at[b]) + 1
            if b + 1 < len(at):
                text = raw[a : int(at[b + 1])]
            else:
                text = raw[a:] + _rest(stream, row, name, max_bytes)
            rows.append((first + i, row["start"] + a, text))
        # an array without elements has one stretch of white space
        rows = [r for r in rows if r[2].strip()]
        for i in range(0, len(rows), 4096):
            o, p, t = zip(*rows[i : i + 4096])
            yield pa.record_batch([pa.array([stream.name] * len(o)), pa.array(o, pa.int64()), pa.array(p, pa.int64()), pa.array(t, pa.binary())], names=["stream", "ordinal", "offset", "value"])

    return work


def _rest(stream: Stream, row: dict, name: bytes | None, max_bytes: int) -> bytes:
    """What of a block's last element is in later blocks."""
    level = 0 if name is None else 1
    end = row["start"] + row["n"]
    buf = np.frombuffer(stream.read(row["start"], row["n"]), dtype=np.uint8)
    _, change, state = _depths(buf, row["state"])
    depth, out = row["depth"] + int(change.sum()), []
    while end < stream.size:
        more = stream.read(end, MORE)
        buf = np.frombuffer(more, dtype=np.uint8)
        outside, change, state = _depths(buf, state)
        after = depth + np.cumsum(change, dtype=np.int64)
        stop = np.flatnonzero(outside & ((buf == COMMA) & (after == level + 1) | (buf == 93) & (after == level)))
        if len(stop):
            out.append(more[: int(stop[0])])
            return b"".join(out)
        out.append(more)
        end, depth = end + len(more), int(after[-1])
        if sum(map(len, out)) > max_bytes:
            raise ValueError(f"an element of {stream.name} is longer than {max_bytes} bytes")
    raise ValueError(f"{stream.name} ends inside of an array")


def elements(spark: SparkSession, of: list[Stream], name: str | None = None, block: int = BLOCK, max_bytes: int = 64 << 20) -> DataFrame:
    """The elements of an array of each document: stream, ordinal (from 0), offset (of the byte after the bracket or comma before it), value (its text).

    name: the member of the document that is the array (as written between its quotes); None: the document itself. Member names are compared as bytes, at the top level only. An element of over max_bytes
    fails the read. The array of a member that occurs twice gives the elements of both."""
    wanted = None if name is None else name.encode()
    at = index(spark, of, block).repartition(width(spark, of, block), "stream", "block")
    found = at.mapInArrow(each(of, _finding(wanted)), BLOCKS_DDL + ", state int, depth long, open_after boolean, found array<long>")
    found = staged(found, "elements")  # the prefix sums and the next pass read it
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("open", F.coalesce(F.last("open_after", ignorenulls=True).over(before), F.lit(False)))
    found = found.withColumn("own", F.when(F.col("open"), F.col("found")[1]).otherwise(F.col("found")[0]))
    found = found.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).where("own > 0").drop("found", "open_after")
    cut = found.repartition(width(spark, of, block), "stream", "block").mapInArrow(each(of, _cutting(wanted, max_bytes)), "stream string, ordinal long, offset long, value binary")
    return cut.withColumn("value", F.trim(F.col("value").cast("string")))
