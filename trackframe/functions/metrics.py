"""Aggregates: errors, trajectory metrics, gates, summaries. All are Columns for agg()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, clamp01


def rmse(prediction, truth) -> Column:
    d = _c(prediction) - _c(truth)
    return F.sqrt(F.avg(d * d))


def population_sre(prediction, truth, zero_variance: str = "rmse") -> Column:
    """RMSE over the truth's population deviation; where that is 0, the RMSE or an error."""
    sd = F.stddev_pop(_c(truth))
    zero = rmse(prediction, truth) if zero_variance == "rmse" else F.raise_error(F.lit("truth has no variance")).cast("double")
    return F.when(sd == 0, zero).otherwise(rmse(prediction, truth) / sd)


def point_errors(px, py, tx, ty) -> tuple[Column, Column]:
    """Distance and squared distance; null where the truth is masked."""
    dx, dy = _c(px) - _c(tx), _c(py) - _c(ty)
    return F.hypot(dx, dy), dx * dx + dy * dy


def ade(distance) -> Column:
    return F.avg(_c(distance))


def fde(distance, is_final) -> Column:
    return F.avg(F.when(_c(is_final), _c(distance)))


def xy_rmse(squared) -> Column:
    return F.sqrt(F.sum(_c(squared)) / (2 * F.count(_c(squared))))


def weighted_progress(sre, weight, floor, ceiling) -> Column:
    """Weighted mean of clamp(1 - sre / min(floor, ceiling))."""
    w = _c(weight)
    return F.sum(w * clamp01(1 - _c(sre) / F.least(_c(floor), _c(ceiling)))) / F.sum(w)


def gate(quality_error, limit: float = 0.30) -> Column:
    return F.max(_c(quality_error)) <= limit


def all_or_null(value) -> Column:
    """Mean, null if any value is null."""
    return F.when(F.count_if(_c(value).isNull()) == 0, F.avg(_c(value)))


def standard_error(x) -> Column:
    return F.stddev_samp(_c(x)) / F.sqrt(F.count(_c(x)))


def masked_mean(value, mask) -> Column:
    """Sum of value where mask, over the number of masks or 1."""
    return F.sum(F.when(_c(mask), _c(value)).otherwise(0.0)) / F.greatest(F.count_if(_c(mask)), F.lit(1))


def linear_percentile(x, q: float) -> Column:
    return F.percentile(_c(x), q)
