"""Scores of cells: the form that finds a scene's part once against the one that holds every cell's points."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators import campaign, scoring
from trackframe.plans import fixtures, scores

CELLS = [("a", 1), ("b", 2), ("c", 3)]
HORIZONS = {"early": (1, 1), "middle": (2, 2), "late": (3, 3)}


def _points(spark):
    p = spark.range(600).select((F.col("id") % 4).alias("m"), F.floor(F.col("id") / 12).alias("w"), (F.floor(F.col("id") / 3) % 4).alias("s"), (F.col("id") % 3 + 1).alias("step"), F.col("id"))
    i = F.col("id")
    q = F.when(i % 5 == 0, "unclassified").when(i % 31 > 2, "detected_only")
    p = p.withColumn("m", F.col("w") % 4).withColumns({"q": q, "bx": i * 1.0, "by": F.when(i % 23 != 0, i % 7 * 1.0), "truth_x": i * 1.1, "truth_y": F.when(i % 37 != 0, i % 5 * 1.0), "mask": F.when(i % 41 != 0, i % 11 != 0)})
    return p.withColumn("s", F.when(F.col("s") > 0, F.col("s")))  # one scene has no name


def _old(spark, p):
    i = 1 + F.col("i") / 10.0
    rows = scoring.with_errors(campaign.predicted_cells(p, spark.createDataFrame(CELLS, "cell string, i int"), F.col("bx") * i, F.col("by") * i, ["cell", "i"]), mask="mask")
    scenes = campaign.scene_strata(rows, ["m", "w", "s", "cell"], "step", "q", HORIZONS, 3)
    return campaign.match_strata(campaign.window_strata(scenes, ["m", "w", "cell"]), ["m", "cell"])


def _new(spark, p, by=lambda c: (c("bx") * (1 + F.col("i") / 10.0), c("by") * (1 + F.col("i") / 10.0))):
    return campaign.cell_strata(p, spark.createDataFrame(CELLS, "cell string, i int"), ["bx", "by"], by, ["cell", "i"], "m", "w", "s", "step", "q", "mask", HORIZONS, 3)


def test_cells_share_what_is_equal(spark):
    p = _points(spark)
    names = ["m", "cell", "stratum", *campaign.METRICS, *campaign.COUNTS]
    got, want = (sorted(map(tuple, df.select(*names).collect())) for df in (_new(spark, p), _old(spark, p)))
    assert [x[:3] + x[6:] for x in got] == [x[:3] + x[6:] for x in want] and len(want) > 50
    assert all(x[3:6] == pytest.approx(y[3:6], rel=1e-12) for x, y in zip(got, want, strict=True))


def test_cells_that_differ_fail(spark):
    p = _points(spark)
    with pytest.raises(Exception, match="lacks a prediction"):
        _new(spark, p, lambda c: (F.when(F.col("i") != 2, c("bx")), c("by"))).collect()
    with pytest.raises(Exception, match="two points"):
        _new(spark, p.union(p)).collect()


def _without_scores(spark, sf, tmp_path):
    """lineitem in which match 6 has no scoreable scene."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    li.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 20 == 6, "R").otherwise(F.col("l_returnflag"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_a_match_without_scores_has_all_its_rows(spark, sf, tmp_path):
    found = scores.optional_strata(spark, _without_scores(spark, sf, tmp_path))
    assert found.where("match_id = 6").groupBy("status").count().collect() == [("not_scoreable", 18 * 8)]
    assert found.count() == 20 * 18 * 8


def test_records_and_their_baseline_are_scored_once(spark, sf):
    found = scores.result_records(spark, sf)
    assert "lineitem.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() and not [f for f in found.inputFiles() if "lineitem" in f]
    assert found.count() == 20 * 18 and {x.match_id for x in found.where("not denominators_equal").collect()} == {3}


def test_second_derivation_is_one_aggregation(spark):
    i = 1 + F.col("i") / 10.0
    rows = scoring.with_errors(campaign.predicted_cells(_points(spark), spark.createDataFrame(CELLS, "cell string, i int"), F.col("bx") * i, F.col("by") * i, ["cell", "i"]), mask="mask")
    found = campaign.recomputed(rows, "m", "w", "s", ["cell"], 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    want = _old(spark, _points(spark)).where("stratum = 'all'")
    assert campaign.tolerance_differences(want, found, ["m", "cell"], campaign.METRICS, 1e-9).count() == 0 and found.count() == 12


def test_partitions_grow_with_the_table(spark):
    li = spark.range(100).select(F.col("id").alias("l_orderkey"))
    assert fixtures.parts(li, 10) == 10 and fixtures.parts(li) == spark.sparkContext.defaultParallelism
