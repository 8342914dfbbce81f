"""Intervals: containment, clipping, merging, coverage, joins on overlap. Phases and periods are half-open,
appearances are closed.

Joins bin the frame axis. An interval of 2^l to 2^(l+1) - 1 frames is of level l and lies in at most three bins of 2^l frames; one of two
overlapping intervals is of the other's level or a higher one, so the shorter one looks it up in the few bins of that level
that it touches itself. Keys are (group, level, bin): a long match, or a single one, is spread over its bins, and what meets in a bin has about a bin's length, so that
pairs that are compared are as many as those that overlap, up to a small factor. Spark's estimates don't count the rows that the bins
add, so that it would broadcast tables of any length: these joins are sorted ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _level(start, end):
    """floor(log2(end - start))."""
    return (F.length(F.bin(end - start)) - 1).cast("int")


def _bin(frame, level):
    return F.call_function("shiftright", frame, level)


def _bins(start, end, level):
    return F.explode(F.sequence(_bin(start, level), _bin(end - 1, level)))


def _own(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin of an interval's own level: adds __l, __bin."""
    return df.withColumn("__l", _level(F.col(start), F.col(end))).withColumn("__bin", _bins(F.col(start), F.col(end), F.col("__l")))


def _looking(df: DataFrame, start: str, end: str, others: DataFrame, other: tuple[str, str], same: bool, first: bool = False) -> DataFrame:
    """A row for each bin that an interval touches (or its first frame does) at each level of the others above its own (or its own too): adds __l, __bin."""
    levels = others.select(_level(F.col(other[0]), F.col(other[1])).alias("l")).agg(F.sort_array(F.collect_set("l")).alias("l")).scalar()  # 63 at most
    own = _level(F.col(start), F.col(end))
    df = df.withColumn("__own", own).withColumn("__l", F.explode(levels)).where((F.col("__l") > F.col("__own")) | (F.lit(same) & (F.col("__l") == F.col("__own"))))
    return df.drop("__own").withColumn("__bin", _bin(F.col(start), F.col("__l")) if first else _bins(F.col(start), F.col(end), F.col("__l")))


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Pairs of half-open intervals left [a, b) and right [c, d) of equal groups that have a frame in common: all columns of left, those of right but ``by``.

    Other columns of the two must differ in name. Empty intervals and nulls match nothing."""
    left = left.where(F.col(a) < F.col(b))
    right = right.where(F.col(c) < F.col(d))
    first = F.greatest(_bin(F.col(a), F.col("__l")), _bin(F.col(c), F.col("__l")))  # a pair meets in its first common bin only
    on = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__bin") == first)
    keys, columns = [*by, "__l", "__bin"], [*left.columns, *[x for x in right.columns if x not in by]]
    up = _looking(left, a, b, right, (c, d), True).join(_own(right, c, d).hint("merge"), keys).where(on).select(*columns)
    down = _own(left, a, b).join(_looking(right, c, d, left, (a, b), False).hint("merge"), keys).where(on).select(*columns)
    return up.unionByName(down)


def union(intervals: DataFrame, by: Sequence[str], a: str, b: str, bits: int = 16) -> DataFrame:
    """by, a, b: the frames that half-open intervals cover, as intervals that don't touch. Intervals are merged within
    stretches of 2^bits frames first, so that a group's last sweep has few rows."""
    i = intervals.select(*by, F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)).where(F.col(a) < F.col(b))
    near = merge(i.withColumn("__near", _bin(F.col(a), F.lit(bits))), [*by, "__near"], a, b).drop("__near", "n")
    return merge(near, by, a, b).drop("n")


def _located(points: DataFrame, covered: DataFrame, by: Sequence[str], at: str, a: str, b: str) -> DataFrame:
    """Rows of points in an interval of union(), with its a and b: at most once each."""
    p = points.withColumn("__at", F.col(at).cast("long")).withColumn("__next", F.col("__at") + 1).where("__at is not null")
    p = _looking(p, "__at", "__next", covered, (a, b), True)
    return p.join(_own(covered, a, b).hint("merge"), [*by, "__l", "__bin"]).where((F.col("__at") >= F.col(a)) & (F.col("__at") < F.col(b))).drop("__l", "__bin", "__at", "__next")


def contained(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """Points that lie in an interval of their group (a semi join), looked up in the union of the intervals."""
    i = intervals.select(*by, F.col(start).cast("long").alias("__a"), (F.col(end) + F.lit(int(closed))).cast("long").alias("__b"))
    return _located(points, union(i, by, "__a", "__b"), by, at, "__a", "__b").select(*points.columns)


def clip(left: DataFrame, right: DataFrame, by: Sequence[str], a: str = "start", b: str = "end") -> DataFrame:
    """Intersections of half-open intervals of equal groups; empty ones are dropped."""
    r = right.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"))
    both = overlapping(left, r, by, a, b, "__a", "__b")
    return both.withColumn(a, F.greatest(a, "__a")).withColumn(b, F.least(b, "__b")).drop("__a", "__b")


def merge(df: DataFrame, by: Sequence[str], a: str = "start", b: str = "end") -> DataFrame:
    """Unions of overlapping or touching intervals: by, start, end, n (intervals merged)."""
    w = Window.partitionBy(*by).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col(a) > reach).cast("int"), F.lit(1)))
    df = df.withColumn("__island", F.sum("__new").over(w))
    return df.groupBy(*by, "__island").agg(F.min(a).alias(a), F.max(b).alias(b), F.count("*").alias("n")).drop("__island")


def coverage(merged: DataFrame, by: Sequence[str], a: str = "start", b: str = "end", history: int = 25, future: int = 15) -> DataFrame:
    """Frames covered, and origins on the even grid whose whole support is inside one interval."""
    origins = F.greatest(F.lit(0), F.floor((F.col(b) - 2 * future - 1) / 2) - F.floor((F.col(a) + 2 * history - 1) / 2))
    return merged.groupBy(*by).agg(F.sum(F.col(b) - F.col(a)).alias("frames"), F.sum(origins).cast("long").alias("origins"))


def first_uncovered(spans: DataFrame, intervals: DataFrame, by: Sequence[str], span_start: str, span_end: str, a: str = "start", b: str = "end") -> DataFrame:
    """For each span [span_start, span_end] (closed): the first frame no interval covers, or null.

    It is the span's start, or the end of the interval of the union that covers the start, if the span goes on so far."""
    i = intervals.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"))
    starts = spans.select(*by, span_start).distinct()
    reach = _located(starts, union(i, by, "__a", "__b"), by, span_start, "__a", "__b").drop("__a")
    j = spans.join(reach, [*by, span_start], "left")
    first = F.when(F.col("__b").isNull(), F.col(span_start)).when(F.col("__b") <= F.col(span_end), F.col("__b"))
    return j.withColumn("first_uncovered", first).select(*spans.columns, "first_uncovered")


def locate(rows: DataFrame, periods: DataFrame, by: Sequence[str], a: str, b: str, p_start: str, p_end: str) -> DataFrame:
    """Adds n_periods: in how many intervals of its group each row lies wholly (1 is required).

    Such an interval is of the row's level or a higher one, and has the row's first frame in just one of its bins."""
    p = periods.select(*by, F.col(p_start).alias("__s"), (F.col(p_end) + 1).alias("__e")).where("__s < __e")
    spans = rows.select(*by, F.col(a).alias("__a"), (F.col(b) + 1).alias("__b")).distinct().where("__a < __b")
    both = _looking(spans, "__a", "__b", p, ("__s", "__e"), True, first=True).join(_own(p, "__s", "__e").hint("merge"), [*by, "__l", "__bin"])
    n = both.where("__a >= __s and __b <= __e").groupBy(*by, F.col("__a").alias(a), (F.col("__b") - 1).alias(b)).agg(F.count(F.lit(1)).alias("n_periods"))
    return rows.join(n, [*by, a, b], "left").select(*rows.columns, F.coalesce("n_periods", F.lit(0)).alias("n_periods"))


def in_order(phases: DataFrame, by: Sequence[str], period: str, start: str, end: str) -> DataFrame:
    """by, intervals: each group's (period, start, end) in order."""
    return phases.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(period, start, end))).alias("intervals"))
