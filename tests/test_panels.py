"""Truth panels against brute force, and what they shuffle."""

from pyspark.sql import functions as F

from trackframe.operators import panels
from trackframe.plans import queries


def test_truth_of_each_step(spark):
    players = [(m, p, f, float(f), None if f % 5 == 0 else 1.0) for m in (1, 2) for p in (1, 2, None) for f in range(0, 40, 1 + m)] + [(1, 1, 8, 7.5, 2.5), (1, 1, None, 1.0, 1.0)]
    origins = [(1, 1, 0), (1, 1, 0), (1, 2, 31), (2, None, 3), (2, 2, 6), (3, 1, 2), (1, 1, None)]
    o = spark.createDataFrame(origins, "m int, player_id long, origin_frame long").withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})
    t = spark.createDataFrame(players, "m int, player_id long, frame long, x double, y double")
    want = []
    for m, p, f in origins:
        for step in range(1, 16):
            hits = [(x, y) for a, b, g, x, y in players if None not in (p, f) and (a, b) == (m, p) and g == f + 2 * step] or [(None, None)]
            want += [(m, p, None if f is None else f + 2 * step, f, 1.0, 2.0, step, *((x, y) if y is not None else (None, None))) for x, y in hits]
    found = panels.truth_panel(o, t, ["m"])
    assert found.columns == ["m", "player_id", "frame", "origin_frame", "origin_x", "origin_y", "step", "truth_x", "truth_y"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_rows_of_steps_are_not_joined(spark, sf):
    plan = queries.truth_panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
