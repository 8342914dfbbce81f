"""Seeded generators of tracking data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_walk(spark: SparkSession, windows: int, players: int = 22, slots: int = 41, sigma: float = 0.35, missing: float = 0.1, seed: int = 7) -> DataFrame:
    """window_id, player_id, slot, x, y, present: Gaussian walks with Bernoulli gaps."""
    grid = spark.range(windows).select(F.col("id").alias("window_id"), F.explode(F.sequence(F.lit(0), F.lit(players - 1))).alias("player_id"))
    grid = grid.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def unit(salt):  # a hash of the place, so that a lost partition comes back equal
        h = F.xxhash64(F.lit(seed), F.lit(salt), "window_id", "player_id", "slot")
        return (F.shiftrightunsigned(h, 11) + 0.5) / float(1 << 53)

    def gauss(salt):
        return F.sqrt(-2 * F.log(unit(salt))) * F.cos(unit(salt + 1) * 6.283185307179586)

    w = Window.partitionBy("window_id", "player_id").orderBy("slot")
    return grid.select("window_id", "player_id", "slot", F.sum(gauss(0) * sigma).over(w).alias("x"), F.sum(gauss(2) * sigma).over(w).alias("y"), (unit(4) >= missing).alias("present"))


def match_frames(spark: SparkSession, matches: int, start: int = 100, frames: int = 100, players: int = 16, seed: int = 3) -> DataFrame:
    """Raw 10 Hz frames in the native shape, two teams, period 1."""
    f = spark.range(matches).select((F.col("id") + 1).alias("match_id"), F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + frames - 1).cast("long"))).alias("frame"))

    def at(salt, i):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "match_id", i), F.lit(2000)) - 1000) / 50.0

    def player(i):
        drift = (F.col("frame") - start) * 0.05
        return F.struct(i.cast("long").alias("player_id"), (at(1, i) + drift).alias("x"), at(2, i).alias("y"), (i % 5 != 0).alias("is_detected"))

    ds = F.col("frame")
    clock = F.format_string("%02d:%02d:%02d.%02d", F.floor(ds / 36000), F.floor(ds / 600) % 60, F.floor(ds / 10) % 60, (ds % 10) * 10)
    ball = F.struct((ds * 0.01).alias("x"), (ds * 0.02).alias("y"), F.lit(0.0).alias("z"), F.lit(True).alias("is_detected"))
    possession = F.struct(F.lit("home team").alias("group"), F.lit(1).cast("long").alias("player_id"))
    return f.select(
        "match_id", "frame", clock.alias("timestamp"), F.lit(1).alias("period"), ball.alias("ball_data"), possession.alias("possession"),
        F.transform(F.sequence(F.lit(1), F.lit(players)), player).alias("player_data"),
    )
