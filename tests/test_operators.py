"""Golden and edge cases of the engine's operators."""

import hashlib
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackframe.functions import metrics as M
from trackframe.functions import scalar as S
from trackframe.operators import audit, eligibility, intervals, panels, samples, scoring, sequences, stats
from trackframe.params import Params
from trackframe.sources import files, synthetic


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_clock(spark):
    texts = ["00:00:01.20", "01:02:03.40", "00:00:01.25", "00:61:00.00", "x", None, "00:00:01.2"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.clock_deciseconds("t").alias("v")).collect()]
    assert got == [12, 37234, None, None, None, None, None]


def test_piecewise_linear(spark):
    knots = [(0, 0), (0.5, 0.25), (1, 1)]
    assert [one(spark, v=S.piecewise_linear(F.lit(x), knots)).v for x in (-1.0, 0.25, 2.0)] == [0.0, 0.125, 1.0]
    with pytest.raises(ValueError):
        S.piecewise_linear("x", [(0, 0), (0, 1)])


def test_ratio_and_finiteness(spark):
    r = one(spark, a=S.safe_ratio(F.lit(1), F.lit(0)), b=S.safe_ratio(F.lit(1), F.lit(4)), c=S.is_finite(F.lit(float("inf"))), d=S.is_finite(F.lit(float("nan"))), e=S.is_finite(F.lit(None).cast("double")), f=S.is_finite(F.lit(1.0)))
    assert r == Row(a=None, b=0.25, c=False, d=False, e=False, f=True)


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0)], "p double, t double")
    r = df.agg(M.rmse("p", "t").alias("a"), M.population_sre("p", "t").alias("b")).first()
    assert math.isclose(r.a, 2**-0.5) and math.isclose(r.b, 2**-0.5)
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, t double")
    assert flat.agg(M.population_sre("p", "t").alias("b")).first().b == 1.0
    with pytest.raises(Exception, match="no variance"):
        flat.agg(M.population_sre("p", "t", "error").alias("b")).collect()
    gates = [spark.createDataFrame([(x,) for x in v], "q double").agg(M.gate("q").alias("g")).first().g for v in ([0.2, 0.3], [0.3, 0.300001])]
    assert gates == [True, False]


def test_hierarchy_weights(spark):
    rows = []
    for m, w, s, e in [(0, 0, "h", 0.0), (0, 0, "a", 6.0), (0, 1, "h", 10.0), (0, 1, "a", 10.0), (1, 0, "h", 0.0), (2, 0, "h", 0.0), (3, 0, "h", 0.0)]:
        rows += [(m, w, s, step, e, 0.0, 0.0, 0.0, step == 3) for step in (1, 2, 3)]
    df = spark.createDataFrame(rows, "match_id int, window_id int, scene_id string, step int, pred_x double, pred_y double, truth_x double, truth_y double, is_final boolean")
    scenes, windows, matches, population = scoring.hierarchy(scoring.with_errors(df))
    assert windows.where("match_id = 0 and window_id = 0").first().ade == 3.0
    assert matches.where("match_id = 0").first().ade == 6.5
    assert population.first().ade == 1.625
    masked = df.withColumn("truth_x", F.when((F.col("match_id") == 3) & (F.col("step") == 3), None).otherwise(F.col("truth_x")))
    scenes, _, matches, population = scoring.hierarchy(scoring.with_errors(masked))
    assert scenes.where("match_id = 3").first().status == "no_final_target"
    assert matches.where("match_id = 3").first().ade is None and population.first().ade is None


def test_baselines(spark):
    line = [("v", k, 2 + 0.2 * (k + 5), -1 - 0.4 * (k + 5)) for k in range(-5, 1)]
    sparse = [("s", -5, 0.0, 0.0), ("s", 0, 1.0, 2.0)] + [("s", k, None, None) for k in range(-4, 0)]
    single = [("p", 0, 7.0, 8.0), ("p", -1, None, 1.0)]
    fit = sequences.baseline_fit(spark.createDataFrame(line + sparse + single, "k string, slot int, x double, y double"), ["k"], "slot", "x", "y")
    got = {(r.k, r.step): (round(r.pred_x, 9), round(r.pred_y, 9)) for r in sequences.extrapolate(fit, 15).collect()}
    assert got["v", 1] == (3.2, -3.4) and got["v", 15] == (6.0, -9.0)
    assert got["s", 15] == (4.0, 8.0) and got["p", 9] == (7.0, 8.0)


def test_intervals(spark):
    iv = spark.createDataFrame([(1, 100, 120), (1, 120, 130), (1, 125, 128), (1, 200, 240), (2, 5, 6)], "k int, start long, end long")
    assert [(r.k, r.start, r.end, r.n) for r in intervals.merge(iv, ["k"]).orderBy("k", "start").collect()] == [(1, 100, 130, 3), (1, 200, 240, 1), (2, 5, 6, 1)]
    spans = spark.createDataFrame([(1, 100, 129), (1, 100, 130), (1, 90, 101), (1, 205, 239), (3, 0, 4)], "k int, a long, b long")
    got = {(r.k, r.a, r.b): r.first_uncovered for r in intervals.first_uncovered(spans, iv, ["k"], "a", "b").collect()}
    assert got == {(1, 100, 129): None, (1, 100, 130): 130, (1, 90, 101): 90, (1, 205, 239): None, (3, 0, 4): 0}
    pts = spark.createDataFrame([(1, 100), (1, 130), (1, 240), (2, 6)], "k int, at long")
    assert sorted((r.k, r.at) for r in intervals.contained(pts, iv, ["k"], "at", "start", "end").collect()) == [(1, 100)]
    assert len(intervals.contained(pts, iv, ["k"], "at", "start", "end", closed=True).collect()) == 4


def test_support_counts_frames_not_rows(spark):
    df = spark.createDataFrame([(1, f) for f in [*range(0, 40, 2), *range(50, 60, 2)]], "m int, frame long")
    w = {r.frame: r.n_support for r in sequences.support(df, ["m"], "frame", 5, 3).collect()}
    g = sequences.slots(df.withColumnRenamed("frame", "o"), df, ["m"], "o", "frame", 5, 3).groupBy("o").agg(F.count_if("present").alias("n"))
    assert w == {r.o: r.n for r in g.collect()} and w[20] == 9 and w[50] == 4


def window(spark, change=None):
    rows = [dict(w=1, slot=k - 5, present=True, period=1, idx=50 + k, frame=100 + 2 * k, clock=200 + 2 * k, start_frame=100, end_frame=200, ball_ok=True) for k in range(9)]
    if change:
        change(rows)
    s = spark.createDataFrame([Row(**r) for r in rows], "w int, slot int, present boolean, period int, idx long, frame long, clock long, start_frame long, end_frame long, ball_ok boolean")
    s = eligibility.slot_codes(eligibility.adjacency(s, ["w"]))
    p = Params(history=5, future=3)
    out = eligibility.windows(s, ["w"], ["pair_codes", "slot_codes"]).join(eligibility.ball_rules(s, ["w"], p), "w").first()
    return sorted([*out.exclusion_reasons, *out.ball_codes])


def edit(i, **values):
    return lambda rows: rows[i].update(values)


@pytest.mark.parametrize(
    "change, code",
    [
        (edit(3, present=False), "TEMPORAL_GAP"), (edit(3, clock=1), "TIMESTAMP_DISCONTINUITY"), (edit(3, clock=None), "TIMESTAMP_MISSING"), (edit(8, frame=300), "OUTSIDE_PERIOD_BOUNDS"),
        (edit(3, frame=107), "CANONICAL_FRAME_MISMATCH"), (edit(8, period=2), "PERIOD_BOUNDARY_CROSSED"), (edit(3, start_frame=None), "PERIOD_BOUNDS_MISSING"), (edit(3, idx=52, frame=104), "DUPLICATE_SAMPLE"),
        (edit(3, idx=40, frame=80), "NONMONOTONIC_SAMPLE_ORDER"), (edit(3, period=None), "INVALID_SAMPLE_SCHEMA"), (edit(5, ball_ok=False), "BALL_MISSING_AT_ORIGIN"), (edit(2, ball_ok=None), "BALL_COVERAGE_BELOW_MINIMUM"),
    ],
)
def test_each_rule_fires(spark, change, code):
    assert window(spark) == []
    assert code in window(spark, change)


def test_player_dispositions(spark):
    base = dict(n_same=1, team_ok=True, is_detected=True, x=1.0, y=1.0, pitch_length=100.0, pitch_width=60.0, in_appearance=True)
    cases = [({}, "valid"), ({"n_same": 2, "x": None}, "DUPLICATE_PLAYER_ID"), ({"team_ok": None}, "PLAYER_TEAM_IDENTITY_CONFLICT"), ({"is_detected": None}, "INVALID_DETECTION_FLAG"), ({"x": None}, "PLAYER_COORDINATES_MISSING"), ({"x": float("nan")}, "NONFINITE_COORDINATE"), ({"x": 101.0}, "COORDINATE_IMPLAUSIBLE"), ({"in_appearance": False}, "PLAYER_OUTSIDE_APPEARANCE"), ({"in_appearance": None}, "valid"), ({"y": 31.0}, "PLAYER_POSITION_OUTSIDE_PITCH")]
    ddl = "n_same int, team_ok boolean, is_detected boolean, x double, y double, pitch_length double, pitch_width double, in_appearance boolean"
    df = spark.createDataFrame([Row(**(base | c)) for c, _ in cases], ddl)
    assert sorted(r.d for r in df.select(eligibility.player_disposition().alias("d")).collect()) == sorted(w for _, w in cases)


def test_bounds_and_phases(spark):
    p = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (2, 1, 0, 9), (2, 1, 0, 9), (3, 1, 9, 9), (4, 1, 0, 9), (4, 2, 9, 12)], "match_id int, period int, start_frame long, end_frame long")
    got = {(r.match_id, r.period): r.period_codes for r in eligibility.period_problems(p).collect()}
    assert got[1, 2] == ["PERIOD_BOUNDS_CONFLICT"] and got[2, 1] == ["PERIOD_BOUNDS_DUPLICATE"] and got[3, 1] == ["PERIOD_BOUNDS_INVALID"] and got[4, 1] == got[4, 2] == []
    ph = spark.createDataFrame([(1, 2, "x", 5, 5)], "match_id int, phase_match_id int, release_id string, start long, end long")
    assert eligibility.phase_problems(ph, "r").first().phase_codes == ["PHASE_INTERVAL_INVALID", "PHASE_MATCH_ID_MISMATCH", "PHASE_SOURCE_IDENTITY_MISMATCH"]


def test_readers_reject_what_is_not_a_frame(spark, tmp_path):
    good = {"frame": 2, "timestamp": "00:00:00.20", "period": 1, "ball_data": None, "possession": None, "image_corners_projection": None, "player_data": []}
    lines = [json.dumps(good), "", json.dumps(good | {"extra": 1}), json.dumps(good)[:-1] + ', "frame": 3}', json.dumps(good | {"frame": True}), "{", json.dumps({k: v for k, v in good.items() if k != "period"})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    rows, bad = files.read_tracking(spark, str(tmp_path / "t.jsonl"))
    assert rows.count() == 1
    assert sorted(r.problem for r in bad.collect()) == ["blank", "keys", "keys", "keys", "keys", "type"]
    (tmp_path / "p.csv").write_text("period,frame_start,frame_end\n1,5,9\n1,9,5\n1,x,7\n")
    rows, bad = files.read_phases(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in rows.collect()] == [(1, 5, 9)] and bad.count() == 2


def test_metadata_views(spark, tmp_path):
    m = {"id": 1, "home_team": {"id": 10}, "away_team": {"id": 20}, "pitch_length": 100, "pitch_width": 60, "match_periods": [{"period": 1, "start_frame": 100, "end_frame": 200}],
         "players": [{"id": 5, "team_id": 20, "playing_time": {"by_period": [{"name": "period_1", "start_frame": 100, "end_frame": 150}]}}]}
    (tmp_path / "m.json").write_text(json.dumps(m, indent=1))
    meta = files.read_metadata(spark, str(tmp_path / "m.json"))
    assert tuple(files.roster(meta).first()) == (1, 5, 20, "away team")
    assert tuple(files.periods(meta).first()) == (1, 1, 100, 200)
    assert tuple(files.appearances(meta).first()) == (1, 5, 1, 100, 150)


def test_native_frames_end_to_end(spark):
    s = samples.canonical(synthetic.match_frames(spark, 2))
    assert s.count() == 100 and s.where("timestamp_deciseconds <> source_frame").count() == 0
    ids = F.transform("players", lambda p: p["player_id"])
    assert s.where(F.array_sort(ids) != ids).count() == 0
    roster = spark.range(1, 17).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("match_id"), F.col("id").alias("player_id"), F.lit("home team").alias("group"))
    p = samples.player_rows(s, roster.where("player_id <= 15"))
    assert p.where("`group` is null").count() == 100
    t = panels.truth_panel(p.where("source_frame = 150").select("match_id", F.col("source_frame").alias("origin_frame"), "player_id", F.col("x_m").alias("x"), F.col("y_m").alias("y")), p.select("match_id", "player_id", F.col("source_frame").alias("frame"), F.col("x_m").alias("x"), F.col("y_m").alias("y")), ["match_id"])
    assert t.count() == 2 * 16 * 15 and t.where("truth_x is null").count() == 0
    d = panels.displacement_panel(t).where("step = 10").first()
    assert abs(d.dx - 1.0 / 52.5) < 1e-9


def test_ball_codes(spark):
    rows = [(None,), ((1.0, 2.0, 0.0, None),), ((1.0, None, 0.0, True),), ((None, None, None, False),), ((1.0, float("inf"), 0.0, True),), ((1.0, 2.0, 3.0, True),)]
    df = spark.createDataFrame(rows, "ball_data struct<x:double,y:double,z:double,is_detected:boolean>")
    got = [r.c for r in df.select(samples.ball_codes().alias("c")).collect()]
    assert got == [["BALL_OBJECT_ABSENT"], ["BALL_DETECTION_UNKNOWN"], ["BALL_COORDINATES_PARTIAL"], ["BALL_COORDINATES_MISSING"], ["NONFINITE_COORDINATE"], []]


def test_statistics(spark):
    rows = [(m, s, 10.0 * m + s) for m in range(4) for s in range(3)]
    df = spark.createDataFrame(rows, "m int, s int, v double")
    r = stats.seed_then_match_mean(df, [], "m", "v").first()
    assert (r["mean"], r.n_matches) == (16.0, 4)
    r = stats.seed_dispersion(df, [], "m", "v").first()
    assert (r.mean_sd, r.max_range) == (1.0, 2.0)
    assert stats.match_summary(df.where("m = 1 and s = 0"), ["m"], "v").first().reason == "one match"
    b = stats.bootstrap_mean(df, ["s"], "v", 200).collect()
    assert all(x.low <= x["mean"] <= x.high for x in b) and len(b) == 3
    assert stats.project_stages(stats.bootstrap_mean(df, ["s"], "v", 50), "s", 10).count() == 4


def test_audit(spark):
    df = spark.createDataFrame([('{"b":1,"a":[1.5,null]}',), ('{"a":1,"a":2}',), ('{"a":NaN}',), ("x",), (None,)], "t string")
    assert [r.c for r in df.select(audit.canonical_text("t").alias("c")).collect()] == ['{"a":[1.5,null],"b":1}', None, None, None, None]
    assert spark.range(1).select(audit.hex_float(F.lit(0.1)).alias("h"), audit.normal_form(F.lit("é")).alias("n")).first() == Row(h=(0.1).hex(), n="é")
    d = S.document_digest(b=F.lit('q"\\x'), a=F.lit("é"))
    want = hashlib.sha256(json.dumps({"a": "é", "b": 'q"\\x'}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, d=d).d == want
    c = audit.hash_chain(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, p string"), ["k"], "o", "p").orderBy("o").collect()
    assert c[1].chain == hashlib.sha256((hashlib.sha256(b"a").hexdigest() + "b").encode()).hexdigest()
    x = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v"))
    row = F.concat_ws(",", "id", "v")
    assert audit.stream_digest(x, ["id"], row).first() == audit.stream_digest(x.repartition(7), ["id"], row).first()
    good, bad = audit.strict_rows(x, F.col("v") == 3)
    assert good.count() + bad.count() == 1000 and bad.count() > 0
    with pytest.raises(Exception, match="breaks a rule"):
        audit.strict_rows(x, F.col("v") == 3, "strict")[0].collect()


def test_sinks_and_inventory(spark, tmp_path):
    df = spark.range(10).withColumn("role", F.col("id") % 2)
    files.write_once(df, f"{tmp_path}/t", ("role",))
    with pytest.raises(Exception):
        files.write_once(df, f"{tmp_path}/t")
    assert files.markdown(df.orderBy("id"), 1).splitlines()[-1] == "| 0 | 0 |"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    assert files.file_inventory(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"x").hexdigest()


def test_generators(spark):
    w = synthetic.random_walk(spark, 3)
    assert w.count() == 3 * 22 * 41 and 0.05 < w.where("not present").count() / w.count() < 0.15
    assert w.orderBy("window_id", "player_id", "slot").limit(5).collect() == synthetic.random_walk(spark, 3).repartition(3).orderBy("window_id", "player_id", "slot").limit(5).collect()
    s = panels.hierarchical_sample(spark.createDataFrame([(1, 1, "h"), (1, 1, "a"), (2, 5, "h")], "m int, w int, s string"), "m", "w", "s", 200)
    n = s.groupBy("m").count().collect()
    assert sum(r["count"] for r in n) == 200 and min(r["count"] for r in n) > 60
