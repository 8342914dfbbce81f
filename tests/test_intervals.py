"""Interval joins against brute force, and how many pairs they compare."""

import random

import pytest
from pyspark.sql import functions as F

from trackframe.operators import intervals as I


def spans(r, n, prefix):
    rows = []
    for i in range(n):
        a = r.choice([r.randint(-50, 50), r.randint(-5000, 5000), r.randint(0, 1 << 40)])
        rows.append((r.choice([1, 2, None]), f"{prefix}{i}", a, a + r.choice([0, 1, 2, 3, 8, 15, 16, 17, 300, 1 << 20, -4])))
    return rows + [(1, prefix + "n", None, 5), (1, prefix + "m", 5, None)]


def test_overlaps_are_those_of_brute_force(spark):
    r = random.Random(3)
    left, right = spans(r, 150, "l"), spans(r, 120, "r")
    a = spark.createDataFrame(left, "k int, l string, a long, b long")
    b = spark.createDataFrame(right, "k int, r string, c long, d long")
    got = sorted((x.l, x.r) for x in I.overlapping(a, b, ["k"], "a", "b", "c", "d").collect())
    ok = lambda s, e: s is not None and e is not None and s < e
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] is not None and x[0] == y[0] and ok(*x[2:]) and ok(*y[2:]) and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 150


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_union_location_and_gaps(spark, bits):
    r = random.Random(bits)
    rows = [(r.choice([1, 2]), a, a + r.choice([0, 1, 3, 9, 60])) for a in (r.randint(-300, 300) for _ in range(60))]
    i = spark.createDataFrame(rows, "k int, a long, b long")
    frames = {(k, f) for k, a, b in rows for f in range(a, b)}
    u = [tuple(x) for x in I.union(i, ["k"], "a", "b", bits).collect()]
    assert sorted((k, f) for k, a, b in u for f in range(a, b)) == sorted(frames)
    assert all((k, b) not in frames and (k, a - 1) not in frames for k, a, b in u)
    points = [(k, f) for k in (1, 2, 3) for f in range(-310, 370, 3)] * 2
    p = spark.createDataFrame(points, "k int, f long")
    assert sorted(map(tuple, I.contained(p, i, ["k"], "f", "a", "b").collect())) == sorted(x for x in points if x in frames)
    closed = {(k, f) for k, a, b in rows for f in range(a, b + 1)}
    assert sorted(map(tuple, I.contained(p, i, ["k"], "f", "a", "b", closed=True).collect())) == sorted(x for x in points if x in closed)
    s = spark.createDataFrame([(k, f, f + n) for k, f in points for n in (0, 5, 80)], "k int, s long, e long")
    for x in I.first_uncovered(s, i, ["k"], "s", "e", "a", "b").collect():
        assert x.first_uncovered == next((f for f in range(x.s, x.e + 1) if (x.k, f) not in frames), None)


def compared(spark, left, right):
    """Pairs that meet in a bin, before any frame is compared."""
    a, b = left.toDF("k", "a", "b"), right.toDF("k", "c", "d")
    keys = ["k", "__l", "__bin"]
    up = I._looking(a, "a", "b", b, ("c", "d"), True).join(I._own(b, "c", "d"), keys)
    down = I._own(a, "a", "b").join(I._looking(b, "c", "d", a, ("a", "b"), False), keys)
    return up.count() + down.count(), I.overlapping(a, b, ["k"], "a", "b", "c", "d").count()


@pytest.mark.parametrize("left, right", [((7, 10), (7, 10)), ((1, 1), (10, 10)), ((3, 2000), (10, 10)), ((1, 1), (1, 64))])
def test_one_match_of_50000_intervals_is_linear(spark, left, right):
    """(step, length) of 50,000 intervals a side, all of one match: all pairs would be 2.5e9."""
    n = 50_000
    one = lambda step, length: spark.range(n).select(F.lit(1), (F.col("id") * step), (F.col("id") * step + length))
    met, matched = compared(spark, one(*left), one(*right))
    assert met < 8 * n + 8 * matched


def test_containment_in_one_match_of_many_overlapping_intervals(spark):
    n = 50_000
    i = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + n).alias("b"))
    p = spark.range(-10, 3 * n, 1).select(F.lit(1).alias("k"), F.col("id").alias("f"))
    assert I.union(i, ["k"], "a", "b").collect() == [(1, 0, 2 * n - 1)]
    assert I.contained(p, i, ["k"], "f", "a", "b").count() == 2 * n - 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_broadcast_no_bins(spark):
    a, b = spark.range(50).selectExpr("id % 3 k", "id a", "id + 20 b"), spark.range(50).selectExpr("id % 3 k", "id c", "id + 90 d")
    for found in (I.overlapping(a, b, ["k"], "a", "b", "c", "d"), I.clip(a, b.toDF("k", "a", "b"), ["k"], "a", "b")):
        assert "Broadcast" not in _plan(found)
    assert I.overlapping(a, b, ["k"], "a", "b", "c", "d").count() == sum(x % 3 == y % 3 and x < y + 90 and y < x + 20 for x in range(50) for y in range(50))


def test_points_broadcast_no_bins(spark):
    p, i = spark.range(50).selectExpr("id % 3 k", "id f"), spark.range(9).selectExpr("id % 3 k", "id a", "id + 5 b")
    found = I.contained(p, i, ["k"], "f", "a", "b")
    assert "Broadcast" not in _plan(found)
    assert found.count() == sum(any(x % 3 == y % 3 and y <= x < y + 5 for y in range(9)) for x in range(50))


def test_location_looks_up_a_row_once_a_level(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 2, None]), a, a + r.choice([-1, 0, 4, 30, 31])) for a in (r.randint(-300, 300) for _ in range(80))] * 2
    periods = [(r.choice([1, 2, None]), a, a + r.choice([-1, 0, 5, 31, 70, 400])) for a in (r.randint(-300, 300) for _ in range(60))]
    p, q = spark.createDataFrame(rows, "k int, a long, b long"), spark.createDataFrame(periods, "k int, s long, e long")
    found = I.locate(p, q, ["k"], "a", "b", "s", "e")
    want = sorted(((k, a, b, sum(k == x and k is not None and s <= a <= b <= e for x, s, e in periods)) for k, a, b in rows), key=str)
    assert sorted((tuple(x) for x in found.collect()), key=str) == want and sum(x[3] for x in want) > 50
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence") == 1  # only the periods are spread over their bins
