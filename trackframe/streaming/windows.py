"""Stateful stream operators, keyed by match: order checks and look-ahead windows.

State is bounded: the last frame, and the frames of at most one window and of pending origins. Frames that
are late or repeated fail the stream unless ``strict`` is off, when they are emitted as status rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "match_id long, origin_frame long, n_support int, complete boolean, status string"
#: last: the newest frame; held: frames that windows still need; done: how many of them have had their row.
STATE = "last long, held array<long>, done int"


def support_stream(frames: DataFrame, history: int = 25, future: int = 15, stride: int = 2, strict: bool = True) -> DataFrame:
    """(match_id long, frame long, is_end boolean) to a row for each origin, emitted as soon as a
    frame at or after the end of its window has come; a row with is_end flushes the match.

    With a column ``ordinal`` (the place in the source) the order inside a trigger is that of the source, and disorder shows there
    too; without it a trigger's frames are taken in the order of their numbers, and only lateness across triggers shows."""
    ahead, behind, whole = future * stride, history * stride, history + future + 1
    order = "ordinal" if "ordinal" in frames.columns else "frame"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, done = state.get if state.exists else (None, [], 0)
        held = np.array(held, dtype=np.int64)
        out = []

        def report(origins, n, status):
            out.append(pd.DataFrame({"match_id": key[0], "origin_frame": origins, "n_support": n, "complete": (n == whole) & (np.asarray(status) == "ok"), "status": status}))

        def emit(limit):
            """Rows of the origins whose windows end by the limit (None: of all)."""
            nonlocal held, done
            to = len(held) if limit is None else max(done, int(np.searchsorted(held, limit - ahead, side="right")))
            origins = held[done:to]
            n = np.searchsorted(held, origins + ahead, side="right") - np.searchsorted(held, origins - behind)
            report(origins, n, np.full(len(origins), "ok", dtype=object))
            done = to
            if done:  # what no pending origin or later one needs
                cut = min(done, int(np.searchsorted(held, (held[done] if done < len(held) else held[-1]) - behind)))
                held, done = held[cut:], done - cut

        # Arrow batches of one trigger: together they are what has come since the last
        part = pd.concat(list(batches)).sort_values(["is_end", order] if order == "frame" else [order], kind="stable")
        ends = np.flatnonzero(part["is_end"].to_numpy())
        f = part["frame"].to_numpy(dtype=np.int64)
        for a, b in zip(np.append(0, ends + 1), np.append(ends, len(f))):
            new = f[a:b]
            if len(new):
                first = np.iinfo(np.int64).min if last is None else last
                before = np.maximum.accumulate(np.append(first, new))[:-1]
                bad = new <= before if last is not None else np.append(False, new[1:] <= before[1:])
                if bad.any() and strict:
                    i = int(np.flatnonzero(bad)[0])
                    raise ValueError(f"match {key[0]}: frame {new[i]} after {before[i]}")
                report(new[bad], np.zeros(int(bad.sum()), dtype=np.int64), np.where(new[bad] == before[bad], "duplicate", "nonmonotonic").astype(object))
                good = new[~bad]
                held = np.append(held, good)
                if len(good):
                    last = int(good[-1])
                    emit(last)
            if b < len(f):  # the match ends here
                emit(None)
                last, held, done = None, held[:0], 0
        if last is not None:
            state.update((last, held.tolist(), done))
        elif state.exists:
            state.remove()
        yield pd.concat(out) if out else pd.DataFrame(columns=["match_id", "origin_frame", "n_support", "complete", "status"])

    return frames.groupBy("match_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
