"""Truth panels, displacement panels and features of directed scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import PITCH, slots_features


def truth_panel(origin_players: DataFrame, players: DataFrame, by: list[str], future: int = 15, stride: int = 2) -> DataFrame:
    """Each player of an origin frame at its future steps: truth_x, truth_y null where unobserved, origin_x, origin_y."""
    keys = [*by, "player_id"]
    o = origin_players.select(*keys, F.col("origin_frame").alias("__at"), F.struct("origin_frame", F.col("x").alias("origin_x"), F.col("y").alias("origin_y")).alias("__o"))
    t = players.select(*keys, F.col("frame").alias("__at"), F.struct(F.col("frame").alias("at"), F.col("x").alias("truth_x"), F.col("y").alias("truth_y")).alias("__t"))
    # a player's rows are sorted once, and each origin sees those of its steps: rows of origins times steps aren't shuffled
    ahead = Window.partitionBy(*keys).orderBy("__at").rangeBetween(stride, future * stride)
    j = o.unionByName(t, allowMissingColumns=True).withColumn("__t", F.collect_list("__t").over(ahead)).where("__o is not null")
    j = j.select(*keys, "__o.*", "__t", F.explode(F.sequence(F.lit(1), F.lit(future))).alias("step")).withColumn("frame", F.col("origin_frame") + F.col("step") * stride)
    known = F.lit(True)
    for c in keys:
        known &= F.col(c).isNotNull()
    here = F.filter("__t", lambda x: (x["at"] == F.col("frame")) & known)
    j = j.select(*keys, "frame", "origin_frame", "origin_x", "origin_y", "step", F.explode_outer(here).alias("__t"))
    whole = F.col("__t.truth_x").isNotNull() & F.col("__t.truth_y").isNotNull()
    return j.withColumns({"truth_x": F.when(whole, F.col("__t.truth_x")), "truth_y": F.when(whole, F.col("__t.truth_y"))}).drop("__t")


def has_last(last: int = 15) -> Column:
    """Aggregate: whether there is any truth at the last step."""
    return F.coalesce(F.bool_or((F.col("step") == last) & F.col("truth_x").isNotNull()), F.lit(False))


def scoreable(panel: DataFrame, by: list[str], last: int = 15) -> DataFrame:
    """Whether a scene has any truth at its last step."""
    return panel.groupBy(*by).agg(has_last(last).alias("scoreable"))


def displacement_panel(panel: DataFrame) -> DataFrame:
    return panel.withColumn("dx", (F.col("truth_x") - F.col("origin_x")) / PITCH[0]).withColumn("dy", (F.col("truth_y") - F.col("origin_y")) / PITCH[1])


def track_features(slots: DataFrame, by: list[str]) -> DataFrame:
    """Flattened (x, y, 1) triples of each track's slots in order, zeros where missing."""
    rows = F.sort_array(F.collect_list(F.struct("slot", "x", "y")))
    return slots.groupBy(*by).agg(slots_features(rows).alias("features"))


def deep_sets(features: DataFrame, weights: dict[str, np.ndarray], by: list[str], steps: int = 15) -> DataFrame:
    """Forward pass of a permutation-invariant network: an encoder of each track, the masked mean
    of a scene's codes as context (of the rows that are ``observed``, over their number or 1; of all without that column), and a
    head on (own code, context). Rows: by, player_id, features. Returns by, player_id, prediction array<double> (2 * steps). A scene is one group."""
    shared = features.sparkSession.sparkContext.broadcast(weights)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*by).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = shared.value
        x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
        code = np.maximum(x @ w["encoder"] + w["encoder_bias"], 0)
        seen = pdf["observed"].to_numpy(dtype=bool) if "observed" in pdf else np.ones(len(code), dtype=bool)
        context = np.repeat(code[seen].sum(axis=0, keepdims=True) / max(seen.sum(), 1), len(code), axis=0)
        out = np.concatenate([code, context], axis=1) @ w["head"] + w["head_bias"]
        return pdf[[*by, "player_id"]].assign(prediction=list(out[:, : 2 * steps]))

    return features.groupBy(*by).applyInPandas(run, f"{names}, player_id long, prediction array<double>")


def hierarchical_sample(scenes: DataFrame, match: str, window: str, scene: str, n: int, seed: int = 0) -> DataFrame:
    """n draws of (match, window, scene), uniform at each level in turn, by hashes of the draw."""
    spark = scenes.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw")

    def pick(rows, keys, c, salt):
        options = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(c)).alias("__o")) if keys else rows.agg(F.array_sort(F.collect_set(c)).alias("__o"))
        return options

    m = draws.join(F.broadcast(pick(scenes, [], match, 0)))
    m = m.select("draw", F.element_at("__o", (F.pmod(F.xxhash64(F.lit(seed), F.lit("m"), "draw"), F.size("__o").cast("long")) + 1).cast("int")).alias(match))
    w = m.join(pick(scenes, [match], window, 1), match)
    w = w.select("draw", match, F.element_at("__o", (F.pmod(F.xxhash64(F.lit(seed), F.lit("w"), "draw"), F.size("__o").cast("long")) + 1).cast("int")).alias(window))
    s = w.join(pick(scenes, [match, window], scene, 2), [match, window])
    return s.select("draw", match, window, F.element_at("__o", (F.pmod(F.xxhash64(F.lit(seed), F.lit("s"), "draw"), F.size("__o").cast("long")) + 1).cast("int")).alias(scene))
