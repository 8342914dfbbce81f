"""Raw frames to eligible windows and truth."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators import eligibility, samples
from trackframe.plans import population
from trackframe.plans.population import produce
from trackframe.sources.synthetic import match_frames


def world(spark):
    frames = match_frames(spark, 1, start=100, frames=100, players=16).withColumn("player_data", F.transform("player_data", lambda p: F.struct(p["player_id"].alias("player_id"), (p["x"] % 40).alias("x"), (p["y"] % 20).alias("y"), p["is_detected"].alias("is_detected"))))
    matches = spark.createDataFrame([(1, 10, 20, 100.0, 60.0)], "match_id long, home long, away long, pitch_length double, pitch_width double")
    roster = spark.range(1, 17).select(F.lit(1).cast("long").alias("match_id"), F.col("id").alias("player_id"), F.when(F.col("id") <= 8, 10).otherwise(20).cast("long").alias("team_id"), F.when(F.col("id") <= 8, "home team").otherwise("away team").alias("group"))
    periods = spark.createDataFrame([(1, 1, 100, 200)], "match_id long, period int, start_frame long, end_frame long")
    appearances = roster.select("match_id", "player_id", F.lit(1).alias("period"), F.lit(100).cast("long").alias("start_frame"), F.lit(199).cast("long").alias("end_frame"))
    phases = spark.createDataFrame([(1, 100, 150), (1, 150, 200)], "match_id long, start long, end long")
    return dict(frames=frames, matches=matches, roster=roster, periods=periods, appearances=appearances, phases=phases)


def eligible(w):
    found, panel = produce(**w)
    rows = found.collect()
    return {r.origin_frame: r.exclusion_reasons for r in rows}, panel


def test_windows_with_whole_support_are_eligible(spark):
    reasons, panel = eligible(world(spark))
    assert len(reasons) == 50
    assert {f for f, r in reasons.items() if not r} == {f for f in range(150, 169, 2)}
    assert reasons[100] and "TEMPORAL_GAP" in reasons[100] and "PHASE_NOT_IN_PLAY_OR_UNKNOWN" in reasons[100]
    assert panel.count() == 10 * 16 * 15 and panel.where("truth_x is null").count() == 0


@pytest.mark.parametrize(
    "name, change, code",
    [
        ("frames", lambda d: d.where("frame <> 160"), "TEMPORAL_GAP"),
        ("frames", lambda d: d.withColumn("ball_data", F.when(~F.col("frame").between(150, 156), F.col("ball_data"))), "BALL_COVERAGE_BELOW_MINIMUM"),
        ("frames", lambda d: d.withColumn("timestamp", F.when(F.col("frame") != 160, F.col("timestamp"))), "TIMESTAMP_MISSING"),
        ("frames", lambda d: d.withColumn("player_data", F.when(F.col("frame") == 160, F.filter("player_data", lambda p: p["player_id"] > 2)).otherwise(F.col("player_data"))), "PLAYER_COUNT_BELOW_TEAM_MINIMUM"),
        ("phases", lambda d: d.where("start = 150"), "PHASE_NOT_IN_PLAY_OR_UNKNOWN"),
        ("matches", lambda d: d.withColumn("away", F.col("home")), "INVALID_MATCH_METADATA"),
        ("roster", lambda d: d.withColumn("team_id", F.when(F.col("player_id") != 3, F.col("team_id")).otherwise(99)), "PLAYER_TEAM_IDENTITY_CONFLICT"),
    ],
)
def test_one_fault_excludes(spark, name, change, code):
    w = world(spark)
    w[name] = change(w[name])
    reasons, _ = eligible(w)
    assert code in reasons[160]


@pytest.mark.parametrize(
    "name, change, code",
    [
        ("appearances", lambda d: d.withColumn("period", F.when(F.col("player_id") != 3, F.col("period"))), "PLAYER_APPEARANCE_METADATA_UNKNOWN"),
        ("frames", lambda d: d.withColumn("player_data", F.when(F.col("frame") == 160, F.filter("player_data", lambda p: p["player_id"] != 3)).otherwise(F.col("player_data"))), "PLAYER_OBSERVATION_MISSING"),
        ("frames", lambda d: d.withColumn("player_data", F.transform("player_data", lambda p: F.struct(p["player_id"].alias("player_id"), F.when((F.col("frame") == 160) & (p["player_id"] == 3), p["x"] - 5).otherwise(p["x"]).alias("x"), p["y"].alias("y"), p["is_detected"].alias("is_detected")))), "PLAYER_DISPLACEMENT_OUTLIER"),
    ],
)
def test_one_fault_warns(spark, name, change, code):
    def warned(w):
        return {r.origin_frame: (set(r.warnings), r.eligible) for r in produce(**w)[0].collect()}

    w = world(spark)
    if code == "PLAYER_DISPLACEMENT_OUTLIER":  # players who stand still
        w["frames"] = w["frames"].withColumn("player_data", F.transform("player_data", lambda p: F.struct(p["player_id"].alias("player_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), p["is_detected"].alias("is_detected"))))
    assert all(code not in x for x, _ in warned(w).values())
    w[name] = change(w[name])
    assert code in warned(w)[160][0] and warned(w)[160][1]


def test_phase_problems_exclude(spark):
    w = world(spark)
    w["phases"] = spark.createDataFrame([(1, 1, "r", 100, 200), (1, 1, "r", 150, 150), (1, 2, "r", 100, 200), (1, 1, "s", 100, 200)], "match_id long, phase_match_id long, release_id string, start long, end long")
    reasons = {r.origin_frame: r.exclusion_reasons for r in produce(**w, release="r")[0].collect()}
    assert reasons[160] == ["PHASE_INTERVAL_INVALID", "PHASE_MATCH_ID_MISMATCH", "PHASE_SOURCE_IDENTITY_MISMATCH"]
    w["phases"] = w["phases"].limit(1)
    assert {r.origin_frame: r.exclusion_reasons for r in produce(**w, release="r")[0].collect()}[160] == []


def test_players_stay_within_their_samples(spark):
    """No row a player and sample is joined or sorted."""
    found, _ = produce(**world(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate explode(players" in x]


def test_duplicates_and_unlisted_players(spark):
    w = world(spark)
    twice = F.concat("player_data", F.filter("player_data", lambda p: p["player_id"] == 2))
    w["frames"] = w["frames"].withColumn("player_data", F.when(F.col("frame") == 160, twice).otherwise(F.col("player_data")))
    w["roster"] = w["roster"].where("player_id <> 5").unionByName(w["roster"].where("player_id = 6"))
    own = {(r.source_frame, x.player_id): x.disposition for r in dispositions(w) for x in r.own}
    for f in (158, 160):
        assert own[f, 5] == "PLAYER_TEAM_IDENTITY_CONFLICT" and own[f, 6] == "DUPLICATE_PLAYER_ID" and own[f, 1] == "valid"
    assert (own[158, 2], own[160, 2]) == ("valid", "DUPLICATE_PLAYER_ID")


def test_two_samples_of_a_frame(spark):
    w = world(spark)
    w["frames"] = w["frames"].unionByName(w["frames"].where("frame = 160"))
    rows = dispositions(w)
    assert [len(r.everyone) for r in rows if r.source_frame in (158, 160)] in ([16, 32, 32], [32, 32, 16], [32, 16, 32])
    assert {x.disposition for r in rows if r.source_frame == 160 for x in r.own} == {"DUPLICATE_PLAYER_ID"}


def dispositions(w):
    matches = eligibility.metadata_problems(w["matches"])
    return population.judged(samples.canonical(w["frames"]), matches, w["roster"], w["periods"], w["appearances"]).collect()
