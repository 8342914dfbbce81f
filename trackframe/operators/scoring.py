"""Trajectory scoring: scene, window, match and population levels, strata, target errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M

METRICS = ("ade", "fde", "rmse")


def with_errors(points: DataFrame, px="pred_x", py="pred_y", tx="truth_x", ty="truth_y", mask=None) -> DataFrame:
    """Adds distance and squared, null where the truth is masked (null, or not ``mask``)."""
    d, s = M.point_errors(px, py, tx, ty)
    if mask is not None:
        d, s = F.when(F.col(mask), d), F.when(F.col(mask), s)
    return points.withColumn("distance", d).withColumn("squared", s)


def scene_scores(points: DataFrame, by: Sequence[str], final: str = "is_final") -> DataFrame:
    """Masked ADE, FDE and XY-RMSE with counts; a scene without a final target has null metrics."""
    finals = F.count(F.when(F.col(final), F.col("distance")))
    out = points.groupBy(*by).agg(
        M.ade("distance").alias("ade"), M.fde("distance", final).alias("fde"), M.xy_rmse("squared").alias("rmse"),
        F.count("distance").alias("n_points"), finals.alias("n_finals"),
    )
    ok = F.col("n_finals") > 0
    return out.withColumns({m: F.when(ok, F.col(m)) for m in METRICS}).withColumn("status", F.when(ok, "scored").otherwise("no_final_target"))


def level(scores: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
    """Equal means of the metrics one level up; strict: null if any member is null."""
    mean = M.all_or_null if strict else F.avg
    return scores.groupBy(*by).agg(*[mean(F.col(m)).alias(m) for m in METRICS], F.count(METRICS[0]).alias("n_scored"), F.count("*").alias("n_members"))


def hierarchy(points: DataFrame, match="match_id", window="window_id", scene="scene_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scene, window, match and population scores. The metrics are averaged with equal weights at
    each level; the population is null if any match is."""
    scenes = scene_scores(points, [match, window, scene])
    windows = level(scenes, [match, window])
    matches = level(windows, [match])
    return scenes, windows, matches, level(matches, [], strict=True)


def micro(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Point-weighted metrics pooled over everything in a group."""
    return points.groupBy(*by).agg(M.ade("distance").alias("ade_micro"), M.fde("distance", "is_final").alias("fde_micro"), M.xy_rmse("squared").alias("rmse_micro"), F.count("distance").alias("n_points"))


def micro_and_macro(points: DataFrame, match="match_id", window="window_id", scene="scene_id") -> DataFrame:
    """match, ade_micro (every point weighs the same) and ade_macro (scenes, then windows do): sums and means go up the levels together."""
    scenes = points.groupBy(match, window, scene).agg(F.sum("distance").alias("d"), F.count("distance").alias("n"), F.count(F.when(F.col("is_final"), F.col("distance"))).alias("m"))
    scenes = scenes.withColumn("ade", F.when(F.col("m") > 0, F.try_divide("d", "n")))
    windows = scenes.groupBy(match, window).agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.avg("ade").alias("ade"))
    return windows.groupBy(match).agg(F.try_divide(F.sum("d"), F.sum("n")).alias("ade_micro"), F.avg("ade").alias("ade_macro"))


def target_errors(long: DataFrame, target: str, prediction: str, truth: str, zero_variance: str = "rmse") -> DataFrame:
    """Population-standardised error of each target."""
    return long.groupBy(target).agg(M.population_sre(prediction, truth, zero_variance).alias("sre"), F.count("*").alias("n"))


def calibrated(errors: DataFrame, calibration: DataFrame, target: str) -> DataFrame:
    """Weighted progress of per-target errors; calibration: target, weight, floor, ceiling."""
    return errors.join(calibration, target).agg(M.weighted_progress("sre", "weight", "floor", "ceiling").alias("progress"), F.count("*").alias("n_targets"))


def channel_errors(long: DataFrame, channel: str, prediction: str, truth: str, region: str | None = None, least: int = 256) -> DataFrame:
    """Per channel: error, quality and whether the region has enough rows."""
    if region is not None:
        long = long.where(F.col(region))
    out = long.groupBy(channel).agg(M.population_sre(prediction, truth).alias("sre"), F.count("*").alias("n"), (F.stddev_pop(truth) == 0).alias("constant_truth"))
    return out.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sre")))).withColumn("enough", F.col("n") >= least)


def dense_paths(points: DataFrame, by: Sequence[str], last_step: int | Column) -> DataFrame:
    """ADE, FDE and XY-RMSE of dense panels: every step of every entity counts. last_step: one for all panels, or a column."""
    return points.groupBy(*by).agg(M.ade("distance").alias("ade"), M.fde("distance", F.col("step") == last_step).alias("fde"), M.xy_rmse("squared").alias("rmse"))
