"""Order-dependent operators: clock checks, grids, gap-aware support, adjacency, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, speed


def frame_order(df: DataFrame, by: Sequence[str], ordinal: str, frame: str) -> DataFrame:
    """Adds frame_status: first, ok, duplicate or nonmonotonic, against the row before."""
    last = F.lag(frame).over(Window.partitionBy(*by).orderBy(ordinal))
    f = F.col(frame)
    return df.withColumn("frame_status", F.when(last.isNull(), "first").when(f == last, "duplicate").when(f < last, "nonmonotonic").otherwise("ok"))


def clock_delta(df: DataFrame, by: Sequence[str], ordinal: str, frame: str, clock: str, period: str, ticks: int = 1) -> DataFrame:
    """Adds clock_ok: within a period the clock advances ticks for each frame."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    same = F.col(period) == F.lag(period).over(w)
    d = (F.col(clock) - F.lag(clock).over(w)) == (F.col(frame) - F.lag(frame).over(w)) * ticks
    return df.withColumn("clock_ok", F.when(same, d).otherwise(True))


def even_grid(periods: DataFrame, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """One row for each even frame of the half-open interval: origin_frame."""
    first, last = F.col(start) + F.pmod(F.col(start), F.lit(2)), F.col(end) - 1
    frames = F.when(first <= last, F.sequence(first, last, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return periods.withColumn("origin_frame", F.explode(frames))


def support(df: DataFrame, by: Sequence[str], frame: str, history: int = 25, future: int = 15, stride: int = 2) -> DataFrame:
    """Adds n_support, the number of rows within the frames of a window around each row, and
    complete. Gaps count: the range is over frames, not rows."""
    w = Window.partitionBy(*by).orderBy(frame).rangeBetween(-history * stride, future * stride)
    return df.withColumn("n_support", F.count("*").over(w)).withColumn("complete", F.col("n_support") == history + future + 1)


def slots(origins: DataFrame, samples: DataFrame, by: Sequence[str], origin: str, frame: str, history: int = 25, future: int = 15, stride: int = 2) -> DataFrame:
    """Grid form of support(): each origin's slots -history..future, left joined to samples."""
    kept = [c for c in samples.columns if c not in (*by, frame)]
    mine = [c for c in origins.columns if c not in by]
    o = origins.select(*by, F.col(origin).cast("long").alias("__at"), F.struct(*mine).alias("__o"))
    s = samples.select(*by, F.col(frame).cast("long").alias("__at"), F.struct(F.col(frame).cast("long").alias("__at"), *kept).alias("__s"))
    # a group's rows are sorted once, and each origin sees the samples around it: rows of origins times slots aren't shuffled
    near = Window.partitionBy(*by).orderBy("__at").rangeBetween(-history * stride, future * stride)
    j = o.unionByName(s, allowMissingColumns=True).withColumn("__s", F.collect_list("__s").over(near)).where("__o is not null")
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()  # as in a join, nulls are no group
    every = F.sequence(F.lit(-history), F.lit(future))
    met = F.transform(F.filter("__s", lambda x: known & ((x["__at"] - F.col("__at")) % stride == 0)), lambda x: F.struct(((x["__at"] - F.col("__at")) / stride).cast("int").alias("slot"), x.alias("s")))
    j = j.withColumn("__met", met)
    gaps = F.transform(F.array_except(every, F.transform("__met", lambda x: x["slot"])), lambda k: F.struct(k.alias("slot"), F.lit(None).cast(s.schema["__s"].dataType).alias("s")))
    j = j.select(*by, "__o", F.explode(F.concat("__met", gaps)).alias("__x"))
    at = (F.col(f"__o.{origin}") + F.col("__x.slot") * stride).alias("slot_frame")
    return j.select(*by, at, *[F.col("__o")[c].alias(c) for c in mine], "__x.slot", *[F.col("__x.s")[c].alias(c) for c in kept], F.col("__x.s").isNotNull().alias("present"))


def adjacent_changes(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_changed for each column: whether it differs from the row before (null is a value)."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.lag(F.lit(1)).over(w).isNull()
    return df.withColumns({f"{c}_changed": ~first & ~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in columns})


def player_speed(df: DataFrame, by: Sequence[str], slot: str, x: str, y: str, limit: float = 12.0, seconds: float = 0.2) -> DataFrame:
    """Adds speed_mps between adjacent slots (null across gaps) and speed_outlier."""
    w = Window.partitionBy(*by).orderBy(slot)
    near = F.col(slot) - F.lag(slot).over(w) == 1
    v = speed(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w), seconds)
    return df.withColumn("speed_mps", F.when(near, v)).withColumn("speed_outlier", F.coalesce(F.col("speed_mps") > limit, F.lit(False)))


def baseline_fit(history: DataFrame, by: Sequence[str], slot: str, x: str, y: str) -> DataFrame:
    """Least-squares lines of both coordinates over the finite history points, and the last point:
    n_points, x_slope, x_at0, y_slope, y_at0, last_x, last_y (slot 0 is the origin)."""
    ok = finite(x) & finite(y)
    s = F.when(ok, F.col(slot).cast("double"))
    at = F.when(ok, F.col(slot))
    return history.groupBy(*by).agg(
        F.count_if(ok).alias("n_points"),
        F.regr_slope(F.when(ok, F.col(x)), s).alias("x_slope"), F.regr_intercept(F.when(ok, F.col(x)), s).alias("x_at0"),
        F.regr_slope(F.when(ok, F.col(y)), s).alias("y_slope"), F.regr_intercept(F.when(ok, F.col(y)), s).alias("y_at0"),
        F.max_by(x, at).alias("last_x"), F.max_by(y, at).alias("last_y"),
    )


def extrapolate(fit: DataFrame, steps: int, model: str = "constant_velocity") -> DataFrame:
    """Steps 1..steps of constant velocity (persistence below two points) or persistence."""
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    line = (F.col("n_points") >= 2) & F.lit(model == "constant_velocity")

    def at(c: str) -> Column:
        return F.when(line, F.col(f"{c}_at0") + F.col(f"{c}_slope") * F.col("step")).otherwise(F.col(f"last_{c}"))

    return out.withColumn("pred_x", at("x")).withColumn("pred_y", at("y"))


def displaced(predictions: DataFrame, x0: str, y0: str) -> DataFrame:
    """Adds dx, dy: predictions relative to an origin."""
    return predictions.withColumn("dx", F.col("pred_x") - F.col(x0)).withColumn("dy", F.col("pred_y") - F.col(y0))


def early_stop(df: DataFrame, by: Sequence[str], step: str, metric: str, patience: int) -> DataFrame:
    """Adds best_before, improved (strictly), since_best (evaluations since) and stop."""
    w = Window.partitionBy(*by).orderBy(step)
    before = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("best_before", before).withColumn("improved", F.col("best_before").isNull() | (F.col(metric) < F.col("best_before")))
    run = F.sum(F.col("improved").cast("int")).over(w)
    df = df.withColumn("__run", run)
    since = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(step)) - 1
    return df.withColumn("since_best", since).withColumn("stop", F.col("since_best") >= patience).drop("__run")


def hash_roles(df: DataFrame, key: str, prefix: str, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """Roles by rank of sha256(prefix + key): the first ``n`` keys get the first role, and so on.

    Meant for a dimension table: ranks are global."""
    rank = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256), key))
    df = df.withColumn("hash_rank", rank)
    role, top = F.lit(None).cast("string"), 0
    cases = []
    for name, n in sizes:
        top += n
        cases.append((F.col("hash_rank") <= top, name))
    for cond, name in reversed(cases):
        role = F.when(cond, F.lit(name)).otherwise(role)
    return df.withColumn("role", role)


def leave_one_out_folds(groups: DataFrame, key: str) -> DataFrame:
    """fold (by order of keys), held_out and each training key. A dimension table."""
    folds = groups.select(F.row_number().over(Window.orderBy(key)).alias("fold"), F.col(key).alias("held_out"))
    return folds.join(groups.select(F.col(key).alias("train")), F.col("train") != F.col("held_out"))


def causal_prefix(stream: DataFrame, queries: DataFrame, by: Sequence[str], ts: str, query: str) -> DataFrame:
    """All rows of a stream up to and including each query time of the same group."""
    return queries.join(stream, list(by)).where(F.col(ts) <= F.col(query))


def causal_running(stream: DataFrame, by: Sequence[str], ts: str, aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates of causal_prefix() at each row's own time; one sort of a group, where the join is quadratic in it."""
    w = Window.partitionBy(*by).orderBy(F.col(ts)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return stream.withColumns({n: a.over(w) for n, a in aggregates.items()})


def origin_times_valid(df: DataFrame, by: Sequence[str], ts: str, origin: str) -> DataFrame:
    """Per group: whether times strictly increase and none is after the origin."""
    d = df.withColumn("__d", F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy("ordinal")))
    return d.groupBy(*by).agg((F.count_if(F.col("__d") <= 0) == 0).alias("increasing"), (F.max(ts) <= F.max(origin)).alias("causal"))
