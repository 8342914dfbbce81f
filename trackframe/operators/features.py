"""Features of directed scenes by information regime, and forward passes of set networks over them.

Tracks are rows (window_id, side, player_id, slot, x, y) with slot -25..15 (0 is the origin); the ball's rows have the same slots
without side and player. Everything but the networks' matrix products is built from Spark's own functions; those are Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import position_features
from ..params import DEFAULTS, Params

#: Width of a team's code, and of the inputs of each regime.
CODE = 16
WIDTHS = {"history_only": 215, "future_ball": 260, "future_opponent_plus_ball": 276}
OTHER = {"home": "away", "away": "home"}


def track_vector(first: int, last: int) -> Column:
    """Flattened (x, y, 1) triples of the slots first..last in the grouped rows, zeros where there is none."""
    rows = F.map_from_entries(F.collect_list(F.when(F.col("slot").between(first, last), F.struct("slot", F.struct("x", "y")))))
    at = F.sequence(F.lit(first), F.lit(last))
    return F.flatten(F.transform(at, lambda s: position_features(F.try_element_at(rows, s)["x"], F.try_element_at(rows, s)["y"])))


def tracks(rows: DataFrame, by: list[str], p: Params = DEFAULTS) -> DataFrame:
    """by, history, future (flattened triples) and seen_history, seen_future: whether there is a row of the track in either part."""
    s = F.col("slot")
    return rows.groupBy(*by).agg(
        track_vector(-p.history, 0).alias("history"), track_vector(1, p.future).alias("future"),
        (F.count_if(s <= 0) > 0).alias("seen_history"), (F.count_if(s > 0) > 0).alias("seen_future"),
    )


def layers(x: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]], last_relu: bool) -> np.ndarray:
    for i, (w, b) in enumerate(weights):
        x = x @ w + b
        if last_relu or i + 1 < len(weights):
            x = np.maximum(x, 0)
    return x


def encoder(spark, weights) -> "Column":
    """A function of a column of vectors: their codes by a small network."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(layers(np.stack(x.to_numpy()), shared.value, True))) if len(x) else x

    return run


def masked_codes(code: str, mask: str) -> Column:
    """Mean of the codes whose mask holds, over their number or 1."""
    n = F.greatest(F.count_if(mask), F.lit(1))
    return F.array(*[F.coalesce(F.sum(F.when(F.col(mask), F.col(code)[i])), F.lit(0.0)) / n for i in range(CODE)])


def scene_features(players: DataFrame, ball: DataFrame, targets: DataFrame, regime: str, history_encoder, future_encoder=None, p: Params = DEFAULTS) -> DataFrame:
    """window_id, side, player_id, features of every target (window_id, side, player_id): own track, codes of both teams, ball, time
    offsets, side; then what the regime adds of the future: ball, and the code of the opponents."""
    if regime not in WIDTHS:
        raise ValueError(f"unknown regime {regime}")
    t = tracks(players, ["window_id", "side", "player_id"], p).withColumn("code", history_encoder("history"))
    aggregates = [masked_codes("code", "seen_history").alias("code")]
    if regime == "future_opponent_plus_ball":
        t = t.withColumn("future_code", future_encoder("future"))
        aggregates.append(masked_codes("future_code", "seen_future").alias("future_code"))
    teams = t.groupBy("window_id", "side").agg(*aggregates)
    own = teams.select("window_id", "side", F.col("code").alias("own_code"))
    other = F.create_map(*[F.lit(x) for pair in OTHER.items() for x in pair])
    rest = [F.col("future_code").alias("their_future")] if regime == "future_opponent_plus_ball" else []
    them = teams.select("window_id", other[F.col("side")].alias("side"), F.col("code").alias("their_code"), *rest)
    b = tracks(ball, ["window_id"], p).select("window_id", F.col("history").alias("ball_history"), F.col("future").alias("ball_future"))
    offsets = F.array(*[F.lit(0.2 * i) for i in range(-p.history, 1)])
    side = F.array(F.when(F.col("side") == "home", 1.0).otherwise(-1.0))
    zeros = F.array(*[F.lit(0.0)] * CODE)
    none = F.array(*[F.lit(0.0)] * (3 * (p.history + 1)))
    j = targets.join(t.select("window_id", "side", "player_id", "history"), ["window_id", "side", "player_id"], "left")
    j = j.join(own, ["window_id", "side"], "left").join(them, ["window_id", "side"], "left").join(b, "window_id", "left")
    parts = [F.coalesce("history", none), F.coalesce("own_code", zeros), F.coalesce("their_code", zeros), F.coalesce("ball_history", none), offsets, side]
    if regime != "history_only":
        parts.append(F.coalesce("ball_future", F.array(*[F.lit(0.0)] * (3 * p.future))))
    if rest:
        parts.append(F.coalesce("their_future", zeros))
    return j.select("window_id", "side", "player_id", F.concat(*parts).alias("features"))


def predicted(features: DataFrame, models: dict[str, list], by: list[str]) -> DataFrame:
    """by, cell, prediction (2 * steps numbers) of every row under every model: models are heads by the name of their cell."""
    shared = features.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def run(cell: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        for name in cell.unique():
            at = np.flatnonzero(cell.to_numpy() == name)
            y = layers(np.stack(x.to_numpy()[at]), shared.value[name], False)
            if not np.isfinite(y).all():
                raise ValueError(f"cell {name} predicts a number that isn't finite")
            for i, v in zip(at, y):
                out.iloc[i] = v
        return out

    cells = features.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in sorted(models)])))
    return cells.select(*by, "cell", run("cell", "features").alias("prediction"))


def truth_problems(panel: DataFrame, scene: list[str], entities: int, steps: int, tolerance: float = 1e-12) -> DataFrame:
    """scene, problem: scenes whose truth isn't whole. panel: a row for each entity and step with x, y, dx, dy (origin-relative), x0, y0, mask.

    Both forms are null together and as the mask says, finite, and describe one trajectory; every entity has every step once."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    form = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    finite = F.lit(True)
    for c in ("x", "y", "dx", "dy", "x0", "y0"):
        finite &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    apart = (F.abs(F.col("dx") - (F.col("x") - F.col("x0"))) > tolerance) | (F.abs(F.col("dy") - (F.col("y") - F.col("y0"))) > tolerance)
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = panel.groupBy(*scene).agg(
        ((F.count("*") != entities * steps) | (F.count_distinct("player_id", "step") != entities * steps)).alias("shape"),
        hit((both != form) | ~F.col("mask").eqNullSafe(both)).alias("mask"), hit(both & form & ~F.coalesce(finite, F.lit(False))).alias("not_finite"), hit(both & form & apart).alias("representations"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("shape", "mask", "not_finite", "representations")]))
    return per.select(*scene, F.explode(names).alias("problem"))
