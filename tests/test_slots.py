"""Slots of windows against brute force, and what they shuffle."""

from pyspark.sql import functions as F

from trackframe.operators import sequences
from trackframe.plans import scores


def test_slots_of_each_origin(spark):
    origins = [(1, 0, "a"), (1, 0, "b"), (1, 6, "c"), (1, 7, "d"), (None, 4, "e"), (2, 4, "f"), (3, None, "g"), (4, 2, "h")]
    held = [(1, f, float(f)) for f in (0, 2, 2, 3, 5, 8, 12)] + [(None, 4, 1.0), (2, 5, 1.0), (3, None, 2.0), (3, 4, 3.0), (4, 0, None)]
    o = spark.createDataFrame(origins, "m long, o long, t string")
    s = spark.createDataFrame(held, "m long, f long, v double")
    want = []
    for m, at, t in origins:
        for k in range(-2, 4):
            f = None if at is None else at + 2 * k
            hits = [(v, True) for n, g, v in held if None not in (m, f) and (n, g) == (m, f)] or [(None, False)]
            want += [(m, f, at, t, k, *x) for x in hits]
    found = sequences.slots(o, s, ["m"], "o", "f", 2, 3)
    assert found.columns == ["m", "slot_frame", "o", "t", "slot", "v", "present"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_rows_of_slots_are_not_shuffled(spark, sf):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scores.ball_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Join" not in plan
    shuffles = [x for x in plan.splitlines() if "Exchange" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)  # of events, by player


def test_no_slot_of_an_empty_table(spark):
    o = spark.createDataFrame([(1, 4)], "m long, o long")
    s = spark.createDataFrame([], "m long, f long, v double")
    found = sequences.slots(o, s, ["m"], "o", "f", 1, 1)
    assert [(r.slot, r.v, r.present) for r in found.orderBy("slot").collect()] == [(-1, None, False), (0, None, False), (1, None, False)]
    assert found.where(F.col("present")).isEmpty()
