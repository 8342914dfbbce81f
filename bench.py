"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "score_hierarchy", "micro_vs_macro", "masked_ade_fde_rmse", "horizon_strata", "gap_aware_support", "eligibility_codes", "interval_merge",
    "interval_coverage", "constant_velocity", "population_sre", "raw_sre_mean", "paired_contrasts", "census_rollup", "early_stop_selection", "record_diff",
    "produced_windows", "cell_strata_scores", "ball_quality", "temporal_quality", "membership_problems",
)


def producer(spark: SparkSession, d: str):
    """Raw frames of 51,714 windows of 41 slots and 22 players to eligible windows; no table is read."""
    from pyspark.sql import functions as F

    from trackframe.plans.population import produce
    from trackframe.sources.synthetic import match_frames

    length = 25857
    near = F.transform("player_data", lambda p: F.struct(p["player_id"].alias("player_id"), (p["x"] % 40).alias("x"), (p["y"] % 20).alias("y"), p["is_detected"].alias("is_detected")))
    ball = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(0.0).alias("z"), F.lit(True).alias("is_detected"))
    frames = match_frames(spark, 4, 0, length, 22).withColumns({"player_data": near, "ball_data": ball})
    ids = spark.range(1, 5).select(F.col("id").alias("match_id"))
    matches = ids.select("match_id", F.lit(10).cast("long").alias("home"), F.lit(20).cast("long").alias("away"), F.lit(105.0).alias("pitch_length"), F.lit(68.0).alias("pitch_width"))
    roster = ids.withColumn("player_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(22).cast("long"))))
    home = F.col("player_id") <= 11
    roster = roster.withColumns({"team_id": F.when(home, 10).otherwise(20).cast("long"), "group": F.when(home, "home team").otherwise("away team")})
    end = F.lit(length).cast("long")
    periods = ids.select("match_id", F.lit(1).alias("period"), F.lit(0).cast("long").alias("start_frame"), end.alias("end_frame"))
    appearances = roster.select("match_id", "player_id", F.lit(1).alias("period"), F.lit(0).cast("long").alias("start_frame"), end.alias("end_frame"))
    phases = ids.select("match_id", F.lit(0).cast("long").alias("start"), end.alias("end"))
    return produce(frames, matches, roster, periods, appearances, phases)[0]


def main() -> None:
    from trackframe.plans.queries import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").agg({"l_quantity": "sum"}).collect()
    took = {}
    queries = {name: QUERIES[name] for name in HEADLINE} | {"producer_51714_windows": producer}
    for name, query in queries.items():
        best = None
        for _ in range(2):
            began = time.time()
            query(spark, d).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
