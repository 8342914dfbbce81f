"""Summaries of results over matches and seeds: contrasts, deletion, dispersion, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M


def seed_then_match_mean(results: DataFrame, by: Sequence[str], match: str, value: str) -> DataFrame:
    """Mean over seeds in each match, then the equal mean over matches."""
    return results.groupBy(*by, match).agg(F.avg(value).alias("__m")).groupBy(*by).agg(F.avg("__m").alias("mean"), F.count("*").alias("n_matches"))


def seed_dispersion(results: DataFrame, by: Sequence[str], match: str, value: str) -> DataFrame:
    """Mean of the within-match seed deviation, and the largest range."""
    per = results.groupBy(*by, match).agg(F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))
    return per.groupBy(*by).agg(F.avg("sd").alias("mean_sd"), F.max("range").alias("max_range"))


def match_summary(scores: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, sample SD and standard error; with one score the SD is null, with a reason."""
    out = scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), M.standard_error(value).alias("se"), F.count(value).alias("n"))
    return out.withColumn("reason", F.when(F.col("n") < 2, "one match"))


def lomo_summary(scores: DataFrame, seed: str, match: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Means by match (over seeds), by seed (over matches) and in all, for each of ``by``, in one pass; g tells which (bits: seed, match are aggregated)."""
    sets = [[*by, seed], [*by, match], list(by)]
    out = scores.groupingSets([[F.col(c) for c in s] for s in sets], *by, seed, match).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    return out.withColumn("g", F.col("g").bitwiseAND(3))


def leave_one_out(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds loo_mean: the mean of the other rows of the group."""
    w = Window.partitionBy(*by)
    return values.withColumn("loo_mean", F.when(F.count(value).over(w) > 1, (F.sum(value).over(w) - F.col(value)) / (F.count(value).over(w) - 1)))


def contrasts(results: DataFrame, by: Sequence[str], cell: str, pairs: Sequence[tuple[str, str, str]], value: str) -> DataFrame:
    """Paired differences left - right of cells that share the other keys: contrast, by, difference."""
    names = sorted({c for _, a, b in pairs for c in (a, b)})
    wide = results.where(F.col(cell).isin(names)).groupBy(*by).pivot(cell, names).agg(F.avg(value))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("difference")) for n, a, b in pairs]))
    return wide.select(*by, rows.alias("x")).select(*by, "x.contrast", "x.difference")


def baseline_delta(results: DataFrame, baseline: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Learned minus baseline on shared keys."""
    return results.join(baseline.withColumnRenamed(value, "__b"), list(on)).withColumn("delta", F.col(value) - F.col("__b")).drop("__b")


def census(rows: DataFrame, levels: Sequence[str], counters: dict) -> DataFrame:
    """Counts rolled up along the levels: null levels are totals, depth tells which."""
    return rows.rollup(*levels).agg(*[c.cast("long").alias(n) for n, c in counters.items()], F.grouping_id().alias("depth"))


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, resamples: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by seeded resampling; groups are small (a score a match)."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].dropna().sort_values().to_numpy()
        rng = np.random.default_rng(seed)
        means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(resamples)]) if len(v) else np.array([np.nan])
        low, high = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame([[*pdf[list(by)].iloc[0], v.mean() if len(v) else None, low, high]], columns=[*by, "mean", "low", "high"])

    return df.groupBy(*by).applyInPandas(run, f"{keys}, mean double, low double, high double")


def project_stages(summary: DataFrame, stage: str, n: int) -> DataFrame:
    """Scales a bootstrap summary of seconds a window to n windows: a row for each stage and their total."""
    per = summary.select(stage, *[(F.col(c) * n).alias(c) for c in ("mean", "low", "high")])
    return per.rollup(stage).agg(*[F.sum(c).alias(c) for c in ("mean", "low", "high")])
