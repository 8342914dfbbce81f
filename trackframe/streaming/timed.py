"""Event-time stream operators: windows that timers end, and a census that updates are folded into.

State is bounded by what the watermark leaves open: the frames of one window and of the allowed lateness a match, and one row of
counters a key. Both run again from their checkpoint folder after a stop, at any point, and give each row once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "match_id long, origin_frame long, n_support int, complete boolean"
#: Where the state of transformWithState is kept; sessions that run support_timed() set it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: The time of frame 0 in milliseconds: what is at the epoch or before is late in every stream.
CLOCK = 86_400_000


def frame_time(frame, per_second: int = 10):
    """Event time of a frame number."""
    return F.timestamp_millis((F.col(frame) if isinstance(frame, str) else frame) * (1000 // per_second) + CLOCK)


class _Windows(StatefulProcessor):
    """A match's open frames (list state), the first origin without its row (value state), and one timer, at the end of that origin's window."""

    def __init__(self, history: int, future: int, stride: int, per_second: int):
        self.behind, self.ahead, self.whole, self.ms = history * stride, future * stride, history + future + 1, 1000 // per_second

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "frame long")
        self.timer = handle.getValueState("timer", "at long, done long")

    def _held(self) -> np.ndarray:
        return np.array([x[0] for x in self.frames.get()], dtype=np.int64) if self.frames.exists() else np.zeros(0, np.int64)

    def _known(self) -> tuple[int | None, int]:
        return tuple(self.timer.get()) if self.timer.exists() else (None, -(1 << 62))

    def _wait(self, held: np.ndarray, at: int | None, done: int) -> None:
        """One timer, at the end of the first open window."""
        rest = held[held > done]
        end = (int(rest.min()) + self.ahead) * self.ms + CLOCK if len(rest) else None
        if end != at:
            if at is not None:
                self.handle.deleteTimer(at)
            if end is not None:
                self.handle.registerTimer(end)
        if end is None:
            self.timer.clear() if not len(held) else self.timer.update((None, done))
        else:
            self.timer.update((end, done))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.unique(np.concatenate([x["frame"].to_numpy(dtype=np.int64) for x in rows]))
        at, done = self._known()
        held = self._held()
        new = np.setdiff1d(new, held)
        if len(new):
            self.frames.appendList([(int(x),) for x in new])
            self._wait(np.concatenate([held, new]), at, done)
        yield pd.DataFrame(columns=["match_id", "origin_frame", "n_support", "complete"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = np.sort(self._held())
        _, done = self._known()
        # windows that end by the watermark: no frame of theirs can come any more
        limit = (timerValues.getCurrentWatermarkInMs() - CLOCK) // self.ms - self.ahead
        origins = held[(held > done) & (held <= limit)]
        n = np.searchsorted(held, origins + self.ahead, side="right") - np.searchsorted(held, origins - self.behind)
        if len(origins):
            done = int(origins[-1])
        rest = held[held > max(done, limit) - self.behind]  # what open or later origins may need
        self.frames.put([(int(x),) for x in rest]) if len(rest) else self.frames.clear()
        self._wait(rest, None, done)
        yield pd.DataFrame({"match_id": key[0], "origin_frame": origins, "n_support": n, "complete": n == self.whole})

    def close(self) -> None:
        pass


def support_timed(frames: DataFrame, history: int = 25, future: int = 15, stride: int = 2, lateness: str = "1 second", per_second: int = 10) -> DataFrame:
    """(match_id long, frame long) to a row for each origin: match_id, origin_frame, n_support (frames in its window), complete.

    A row comes when the watermark, ``lateness`` behind the newest frame of all matches, passes the end of the origin's window: frames may be out of order by
    so much, and no marker ends a match. A frame that is later than that is dropped by Spark; a repeated frame counts once. The session keeps state in STATE_STORE."""
    timed = frames.select("match_id", "frame", frame_time("frame", per_second).alias("at")).withWatermark("at", lateness)
    return timed.groupBy("match_id").transformWithStateInPandas(_Windows(history, future, stride, per_second), OUT, "Append", "EventTime")


def census_stream(rows: DataFrame, levels: Sequence[str], counters: dict) -> DataFrame:
    """Counters by the finest levels, for a stream in update mode: a row for each key that a trigger changed. State is one row a key."""
    return rows.groupBy(*levels).agg(*[c.cast("long").alias(n) for n, c in counters.items()])


def fold_updates(spark: SparkSession, folder: str, levels: Sequence[str], counters: Sequence[str]):
    """A foreachBatch function that keeps the updates of census_stream() under ``folder``: each trigger's keys replace their rows of before.

    A trigger writes its updates as one table named by its number; a trigger that runs again writes the same one again. The census is the newest row
    of each key; every ``64`` triggers the tables are folded into one, so that what is kept is bounded by the keys."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")
        if number % 64 == 63:
            whole = newest(batch.sparkSession, folder, levels).withColumn("__batch", F.lit(number).cast("long"))
            whole.write.mode("overwrite").parquet(f"{folder}/folded/upto={number}")

    return write


def newest(spark: SparkSession, folder: str, levels: Sequence[str]) -> DataFrame:
    """The newest row of each key of a folder of fold_updates(): updates since the last folded table, and that table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(name):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        found = system.listStatus(at) if system.exists(at) else []
        done = [x.getPath() for x in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(x.getName().split("=")[1]) for x in done)

    folded = numbers("folded")[-1:]
    paths = [f"{folder}/folded/upto={n}" for n in folded] + [f"{folder}/updates/batch={n}" for n in numbers("updates") if not folded or n > folded[0]]
    rows = spark.read.parquet(*paths)
    values = [c for c in rows.columns if c not in levels]
    last = rows.groupBy(*levels).agg(F.max_by(F.struct(*values), "__batch").alias("__x"))
    return last.select(*levels, "__x.*").drop("__batch")


def rolled_up(census: DataFrame, levels: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Totals of a census along its levels, as stats.census() gives them."""
    return census.rollup(*levels).agg(*[F.sum(c).alias(c) for c in counters], F.grouping_id().alias("depth"))
