"""Registered queries of campaigns, quality blocks and eligibility rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio
from ..operators import arrays, campaign, constraints, eligibility, intervals, quality, scoring, sequences, stats
from ..params import Params
from ..sources.shared import staged
from . import fixtures as X
from . import population
from .fixtures import sql, table
from .queries import query, r6

LAST = 3
HORIZONS = {"early": (1, 1), "middle": (2, 2), "late": (3, 3)}
NINE = Params(history=5, future=3)

# --- campaigns: 18 cells, seven strata ---

_CELLS = """, ce AS (SELECT r || '/' || p || '/' || s AS cell, i FROM (SELECT r, p, s, row_number() OVER (ORDER BY r, p, s) AS i
  FROM (SELECT unnest(['ball', 'history', 'opponent']) AS r), (SELECT unnest(['absolute', 'displacement']) AS p), (SELECT unnest(['a', 'b', 'c']) AS s))),
pt AS (SELECT scp.*, cell, CASE (window_id + l_linenumber) % 7 WHEN 0 THEN 'unclassified' WHEN 1 THEN 'with_provider_extrapolation' ELSE 'detected_only' END AS q,
  CASE WHEN mask THEN sqrt((pred_x * (1 + i / 100.0::DOUBLE) - truth_x) ** 2 + (pred_y * (1 + i / 100.0::DOUBLE) - truth_y) ** 2) END AS d,
  CASE WHEN mask THEN (pred_x * (1 + i / 100.0::DOUBLE) - truth_x) ** 2 + (pred_y * (1 + i / 100.0::DOUBLE) - truth_y) ** 2 END AS s FROM scp CROSS JOIN ce WHERE step <= 3),
qs AS (SELECT window_id, scene_id, min(q) AS quality FROM pt GROUP BY ALL),
ok AS (SELECT match_id, window_id, scene_id, cell FROM pt WHERE step = 3 AND d IS NOT NULL),
hz AS (SELECT * FROM (VALUES ('all', 1, 3), ('early', 1, 1), ('middle', 2, 2), ('late', 3, 3)) t(stratum, a, b)),
h AS (SELECT match_id, window_id, scene_id, cell, stratum, avg(d) AS ade, avg(CASE WHEN step = b THEN d END) AS fde, sqrt(sum(s) / (2 * count(s))) AS rmse, count(d) AS points, count(CASE WHEN step = b THEN d END) AS finals
  FROM pt JOIN hz ON step BETWEEN a AND b JOIN ok USING (match_id, window_id, scene_id, cell) GROUP BY ALL HAVING count(CASE WHEN step = b THEN d END) > 0),
sc AS (SELECT * FROM h UNION ALL SELECT match_id, window_id, scene_id, cell, quality, ade, fde, rmse, points, finals FROM h JOIN qs USING (window_id, scene_id) WHERE stratum = 'all'),
wi AS (SELECT match_id, window_id, cell, stratum, avg(ade) AS ade, avg(fde) AS fde, avg(rmse) AS rmse, count(*) AS scenes, sum(points) AS points, sum(finals) AS finals FROM sc GROUP BY ALL),
ma AS (SELECT match_id, cell, stratum, avg(ade) AS ade, avg(fde) AS fde, avg(rmse) AS rmse, count(*) AS windows, sum(scenes)::BIGINT AS scenes, sum(points)::BIGINT AS points, sum(finals)::BIGINT AS finals FROM wi GROUP BY ALL)"""


def _base_points(spark, d):
    """Points of the first three steps, with the scene's quality and the predictions that all cells scale."""
    p = X.scene_points(spark, d).where(F.col("step") <= LAST)
    k = (F.col("window_id") + F.col("l_linenumber")) % 7
    p = p.withColumn("q", F.when(k == 0, "unclassified").when(k == 1, "with_provider_extrapolation").otherwise("detected_only"))
    return p.withColumnsRenamed({"pred_x": "base_x", "pred_y": "base_y"})


def _cells(spark):
    names = [f"{r}/{t}/{s}" for r in ("ball", "history", "opponent") for t in ("absolute", "displacement") for s in "abc"]
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "cell string, i int")


def _scaled(base):
    by = 1 + F.col("i") / 100.0
    return base("base_x") * by, base("base_y") * by


def _cell_points(spark, d):
    """_base_points() for each of 18 cells, with errors."""
    rows = campaign.predicted_cells(_base_points(spark, d), _cells(spark), *_scaled(F.col), ["cell", "i"])
    return scoring.with_errors(rows, mask="mask")


def _match_strata(spark, d):
    return campaign.cell_strata(_base_points(spark, d), _cells(spark), ["base_x", "base_y"], _scaled, ["cell", "i"], "match_id", "window_id", "scene_id", "step", "q", "mask", HORIZONS, LAST)


@query(sql("scp") + _CELLS + " SELECT match_id, cell, stratum, round(ade, 6) AS ade, round(fde, 6) AS fde, round(rmse, 6) AS rmse, windows, scenes, points, finals FROM ma")
def cell_strata_scores(spark, d):
    return _match_strata(spark, d).withColumns(r6("ade", "fde", "rmse"))


@query(sql("scp") + _CELLS + """, st AS (SELECT unnest(['all', 'early', 'middle', 'late', 'detected_only', 'with_provider_extrapolation', 'unclassified', 'never']) AS stratum),
g AS (SELECT * FROM (SELECT DISTINCT match_id FROM scp), (SELECT cell FROM ce), st)
SELECT g.match_id, g.cell, g.stratum, coalesce(windows, 0)::BIGINT AS windows, coalesce(points, 0)::BIGINT AS points, CASE WHEN windows > 0 THEN 'scoreable' ELSE 'not_scoreable' END AS status
FROM g LEFT JOIN ma USING (match_id, cell, stratum)""")
def optional_strata(spark, d):
    scores = _match_strata(spark, d)
    matches = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("match_id")).distinct()
    strata = F.array(*[F.lit(s) for s in ("all", *HORIZONS, *campaign.QUALITIES, "never")])
    keys = matches.crossJoin(_cells(spark).select("cell")).withColumn("stratum", F.explode(strata))
    return campaign.completed(scores, keys, ["match_id", "cell", "stratum"]).select("match_id", "cell", "stratum", "windows", "points", "status")


@query(sql("scp") + _CELLS + """ SELECT match_id, cell, windows, scenes, points, finals, match_id <> 3 AS denominators_equal FROM ma WHERE stratum = 'all'""")
def result_records(spark, d):
    scores = staged(_match_strata(spark, d), "scores")  # a few rows, which the baseline needs too
    base = scores.where("stratum = 'all'").groupBy("match_id").agg(*[F.max(c).alias(c) for c in campaign.COUNTS])
    base = base.withColumn("windows", F.col("windows") + F.when(F.col("match_id") == 3, 1).otherwise(0))
    return campaign.result_records(scores, base, "match_id").select("match_id", "cell", *campaign.COUNTS, "denominators_equal")


@query(sql("scp") + _CELLS + """ SELECT match_id, cell, 'ade' AS path, false AS lost FROM ma WHERE stratum = 'all' AND match_id % 5 = 0 AND cell LIKE 'ball/%' AND ade IS NOT NULL
UNION ALL SELECT match_id, cell, unnest(['ade', 'fde', 'rmse']), true FROM ma WHERE stratum = 'all' AND match_id = 7 AND cell = 'history/absolute/a'""")
def independent_recheck(spark, d):
    """Scores held against a second derivation in which some are off and one is lost: what differs, and nothing else."""
    first = _match_strata(spark, d).where("stratum = 'all'").select("match_id", "cell", *campaign.METRICS)
    second = campaign.recomputed(_cell_points(spark, d), "match_id", "window_id", "scene_id", ["cell"], LAST)
    off = (F.col("match_id") % 5 == 0) & F.col("cell").startswith("ball/")
    second = second.withColumn("ade", F.col("ade") + F.when(off, 1e-6).otherwise(0.0)).where("not (match_id = 7 and cell = 'history/absolute/a')")
    bad = campaign.tolerance_differences(first, second, ["match_id", "cell"], campaign.METRICS, 1e-9)
    return bad.select("match_id", "cell", "path", F.col("right_value").isNull().alias("lost"))


@query(sql("scp", "err") + """ SELECT round(avg(a), 6) AS loss, count(a) AS scenes, count(*) - count(a) AS unscoreable FROM (SELECT avg(distance) AS a FROM err GROUP BY window_id, scene_id)""")
def scene_loss(spark, d):
    return campaign.scene_loss(X.scored_points(spark, d), ["window_id", "scene_id"]).withColumns(r6("loss"))


@query(sql("scp", "err") + """ SELECT match_id, round(avg(distance), 6) AS ade, round(avg(CASE WHEN is_final THEN distance END), 6) AS fde, round(sqrt(sum(squared) / (2 * count(squared))), 6) AS rmse,
count(distance) AS points, count(CASE WHEN is_final THEN distance END) AS finals FROM err GROUP BY ALL""")
def validation_scores(spark, d):
    return campaign.pooled(X.scored_points(spark, d), ["match_id"]).withColumns(r6("ade", "fde", "rmse"))


@query(sql("sp") + """, a AS (SELECT match_id, x - lag(x) OVER w AS t, 0.5::DOUBLE * (y - lag(y) OVER w) AS p FROM sp WINDOW w AS (PARTITION BY player_id ORDER BY idx))
SELECT match_id, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, count(*) AS n FROM a WHERE t IS NOT NULL GROUP BY ALL""")
def signed_acceleration(spark, d):
    w = Window.partitionBy("player_id").orderBy("idx")
    p = X.sample_players(spark, d).select("match_id", (F.col("x") - F.lag("x").over(w)).alias("t"), (0.5 * (F.col("y") - F.lag("y").over(w))).alias("p"))
    return campaign.signed_acceleration_error(p.where("t is not null"), ["match_id"], "p", "t").withColumns(r6("rmse"))


@query(sql("scp") + """, m AS (SELECT match_id, window_id, scene_id, 'shrunk' AS model, pred_x AS px, pred_y AS py, truth_x, truth_y FROM scp UNION ALL SELECT match_id, window_id, scene_id, 'doubled', 2 * truth_x, 2 * truth_y, truth_x, truth_y FROM scp),
e AS (SELECT match_id, window_id, scene_id, model, avg(sqrt((px - truth_x) ** 2 + (py - truth_y) ** 2)) AS ade FROM m GROUP BY ALL), w AS (SELECT match_id, window_id, model, avg(ade) AS ade FROM e GROUP BY ALL)
SELECT match_id, model, round(avg(ade), 6) AS ade, count(*) AS windows FROM w GROUP BY ALL""")
def baseline_match_scores(spark, d):
    p = X.scene_points(spark, d).withColumns({"dx": 2 * F.col("truth_x"), "dy": 2 * F.col("truth_y")})
    rows = campaign.baseline_scores(p.withColumnsRenamed({"pred_x": "sx", "pred_y": "sy"}), {"shrunk": ("sx", "sy"), "doubled": ("dx", "dy")})
    e = rows.groupBy("match_id", "window_id", "scene_id", "model").agg(F.avg("distance").alias("ade")).groupBy("match_id", "window_id", "model").agg(F.avg("ade").alias("ade"))
    return e.groupBy("match_id", "model").agg(F.round(F.avg("ade"), 6).alias("ade"), F.count("*").alias("windows"))


@query(sql("sp", "hist") + """, f AS (SELECT player_id, origin, count(x) AS n, regr_slope(x, slot) AS sx, regr_intercept(x, slot) AS ix, regr_slope(y, slot) AS sy, regr_intercept(y, slot) AS iy, arg_max(x, slot) FILTER (x IS NOT NULL) AS lx, arg_max(y, slot) FILTER (x IS NOT NULL) AS ly FROM hist GROUP BY ALL)
SELECT player_id, origin, step, round(CASE WHEN n >= 2 THEN ix + sx * step ELSE lx END - lx, 6) + 0.0 AS dx, round(CASE WHEN n >= 2 THEN iy + sy * step ELSE ly END - ly, 6) + 0.0 AS dy FROM (SELECT *, unnest(range(1, 16))::INT AS step FROM f)""")
def baseline_displacement(spark, d):
    f = sequences.baseline_fit(X.history(spark, d), ["player_id", "origin"], "slot", "x", "y")
    p = sequences.displaced(sequences.extrapolate(f, 15), "last_x", "last_y")
    return p.select("player_id", "origin", "step", (F.round("dx", 6) + 0.0).alias("dx"), (F.round("dy", 6) + 0.0).alias("dy"))


# --- quality blocks ---

_QS = """, q AS (SELECT player_id, frame, idx, event_type, x, y, idx // 30 AS period FROM gp),
sl AS (SELECT o.player_id, o.frame AS origin_frame, k AS slot, s.*, s.frame IS NOT NULL AS present FROM q o CROSS JOIN (SELECT unnest(range(-5, 4)) AS k) g
  LEFT JOIN (SELECT player_id AS pid, frame, idx, event_type, x, y, period FROM q) s ON s.pid = o.player_id AND s.frame = o.frame + 2 * k)"""


def _slots(spark, d):
    p = X.gappy_players(spark, d).select("player_id", "frame", "idx", "event_type", "x", "y", F.floor(F.col("idx") / 30).alias("period"))
    s = sequences.slots(p.select("player_id", F.col("frame").alias("origin_frame")), p, ["player_id"], "origin_frame", "frame", 5, 3)
    return s.withColumn("frame", F.when(F.col("present"), F.col("slot_frame")))


BY = ["player_id", "origin_frame"]


@query(sql("sp", "gp") + _QS + """, b AS (SELECT *, event_type <> 'purchase' AS has, CASE WHEN event_type = 'click' THEN NULL ELSE event_type = 'view' END AS flag, CASE WHEN event_type <> 'signup' THEN x END AS bx, y AS by_ FROM sl)
SELECT player_id, origin_frame, count(CASE WHEN NOT present THEN 1 END) AS missing_samples, count(CASE WHEN present AND NOT has THEN 1 END) AS absent_objects,
  count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) AS valid_positions, count(CASE WHEN has AND flag THEN 1 END) AS flag_true, count(CASE WHEN has AND flag IS NOT NULL THEN 1 END) AS known_flags,
  count(CASE WHEN has AND bx IS NOT NULL AND (abs(bx) > 52.5 OR abs(by_) > 34) THEN 1 END) AS outside_pitch, true AS reconciles,
  round(count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) / 9.0::DOUBLE, 6) AS position_coverage,
  round(count(CASE WHEN has AND flag THEN 1 END) / nullif(count(CASE WHEN has AND flag IS NOT NULL THEN 1 END), 0)::DOUBLE, 6) AS detected_share,
  CASE WHEN count(CASE WHEN has AND bx IS NOT NULL AND flag IS NULL THEN 1 END) > 0 OR bool_or(NOT present) OR count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) = 0 THEN 'unknown'
    WHEN count(CASE WHEN has AND bx IS NOT NULL AND flag THEN 1 END) = count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) THEN 'all_detected'
    WHEN count(CASE WHEN has AND bx IS NOT NULL AND flag THEN 1 END) = 0 THEN 'all_false_flag' ELSE 'mixed' END AS detection_stratum,
  CASE WHEN bool_or(NOT present) THEN 'unknown' WHEN count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) = 9 THEN 'complete' WHEN count(CASE WHEN has AND bx IS NOT NULL THEN 1 END) = 0 THEN 'none' ELSE 'partial' END AS completeness_stratum
FROM b GROUP BY ALL""")
def ball_quality(spark, d):
    t = F.col("event_type")
    s = _slots(spark, d).withColumns({
        "ball_present": F.coalesce(t != "purchase", F.lit(False)), "ball_flag": F.when(t != "click", t == "view"), "ball_x": F.when(t != "signup", F.col("x")),
        "ball_y": F.col("y"), "pitch_length": F.lit(105.0), "pitch_width": F.lit(68.0),
    })
    # a ball without x is partial here: its y is known
    b = quality.ball_block(s, BY, NINE)
    names = ["missing_samples", "absent_objects", "valid_positions", "flag_true", "known_flags", "outside_pitch", "reconciles", "position_coverage", "detected_share", "detection_stratum", "completeness_stratum"]
    return b.withColumns(r6("position_coverage", "detected_share")).select(*BY, *names)


@query(sql("sp") + """, p AS (SELECT *, CASE WHEN event_type <> 'signup' THEN x END AS px, CASE WHEN event_type <> 'view' THEN event_type = 'click' END AS f, idx % 4 <> 0 AS active FROM sp),
g AS (SELECT match_id, idx, count(*) AS records, count(CASE WHEN px IS NOT NULL AND f IS NOT NULL THEN 1 END) AS valid_positions, count(CASE WHEN px IS NULL THEN 1 END) AS null_coordinates,
  count(CASE WHEN px IS NOT NULL AND f THEN 1 END) AS detected, count(CASE WHEN px IS NOT NULL AND NOT f THEN 1 END) AS extrapolated, count(CASE WHEN px IS NOT NULL AND f IS NOT NULL AND (abs(px) > 52.5 OR abs(y) > 34) THEN 1 END) AS outside_pitch,
  count(CASE WHEN px IS NOT NULL AND f IS NOT NULL AND active THEN 1 END) AS active_positions, CASE WHEN match_id <> 5 THEN 6 END AS expected FROM p GROUP BY match_id, idx)
SELECT match_id, idx, records, valid_positions, null_coordinates, detected, extrapolated, outside_pitch, expected - active_positions AS missing_active, round(active_positions / expected::DOUBLE, 6) AS completeness,
  round(extrapolated / nullif(detected + extrapolated, 0)::DOUBLE, 6) AS extrapolation,
  CASE WHEN detected + extrapolated = 0 THEN 'unknown' WHEN extrapolated = 0 THEN 'all_detected' WHEN detected = 0 THEN 'all_extrapolated' ELSE 'mixed' END AS detection_stratum,
  CASE WHEN expected IS NULL THEN 'unknown' WHEN active_positions = expected THEN 'complete' WHEN active_positions = 0 THEN 'none' ELSE 'partial' END AS completeness_stratum FROM g""")
def player_quality(spark, d):
    t = F.col("event_type")
    p = X.sample_players(spark, d).withColumns({
        "x": F.when(t != "signup", F.col("x")), "is_detected": F.when(t != "view", t == "click"), "active": F.col("idx") % 4 != 0,
        "expected_frames": F.when(F.col("match_id") != 5, 6), "pitch_length": F.lit(105.0), "pitch_width": F.lit(68.0),
    })
    b = quality.player_block(p, ["match_id", "idx"]).withColumns(r6("completeness", "extrapolation"))
    return b.select("match_id", "idx", "records", "valid_positions", "null_coordinates", "detected", "extrapolated", "outside_pitch", "missing_active", "completeness", "extrapolation", "detection_stratum", "completeness_stratum")


@query(sql("sp", "gp") + _QS + """, a AS (SELECT *, CASE WHEN idx % 6 < 4 THEN [1, 2] ELSE [2, 3] END AS act, CASE WHEN event_type = 'view' THEN [1] ELSE [1, 2] END AS obs FROM sl),
l AS (SELECT *, lag(present) OVER w AS lp, present AND coalesce(lag(present) OVER w, false) AS both_, frame - lag(frame) OVER w AS df, idx * 2 - lag(idx * 2) OVER w AS dc, period = lag(period) OVER w AS same, obs <> lag(obs) OVER w AS od, act <> lag(act) OVER w AS ad FROM a WINDOW w AS (PARTITION BY player_id, origin_frame ORDER BY slot)),
g AS (SELECT player_id, origin_frame, count(lp) AS expected_intervals, count(CASE WHEN both_ THEN 1 END) AS observed_intervals, count(CASE WHEN both_ AND df = 2 AND dc = 2 AND same THEN 1 END) AS continuous_intervals,
  count(CASE WHEN both_ AND od THEN 1 END) AS observed_changes, count(CASE WHEN both_ AND ad THEN 1 END) AS roster_transitions FROM l GROUP BY ALL)
SELECT *, CASE WHEN roster_transitions > 0 THEN 2 ELSE 0 END AS changed_players, round(CASE WHEN observed_intervals = expected_intervals THEN continuous_intervals / expected_intervals::DOUBLE END, 6) AS continuity,
  CASE WHEN observed_intervals < expected_intervals THEN 'unknown' WHEN continuous_intervals = expected_intervals THEN 'continuous' ELSE 'discontinuous' END AS continuity_stratum,
  CASE WHEN observed_intervals < expected_intervals THEN 'unknown' WHEN roster_transitions > 0 THEN 'exposed' ELSE 'none_observed' END AS transition_stratum FROM g""")
def temporal_quality(spark, d):
    ids = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    s = _slots(spark, d).withColumns({
        "clock": F.col("idx") * 2, "active": F.when(F.col("present"), F.when(F.col("idx") % 6 < 4, ids(1, 2)).otherwise(ids(2, 3))),
        "observed": F.when(F.col("event_type") == "view", ids(1)).otherwise(ids(1, 2)),
    })
    return quality.temporal_block(s, BY).withColumns(r6("continuity")).drop("change_fraction")


@query(sql("sp", "gp") + _QS + """, g AS (SELECT player_id, origin_frame, count(CASE WHEN present THEN 1 END) AS samples, count(CASE WHEN event_type = 'click' THEN 1 END) AS home, count(CASE WHEN event_type = 'view' THEN 1 END) AS away FROM sl GROUP BY ALL)
SELECT player_id, origin_frame, samples, home, away, samples - home - away AS unknown, round(home / nullif(samples, 0)::DOUBLE, 6) AS home_fraction,
  CASE WHEN origin_frame % 3 = 0 THEN 'unknown' WHEN origin_frame % 4 = 0 THEN 'all_in_play' ELSE 'uncovered_or_unknown' END AS play_stratum FROM g""")
def play_quality(spark, d):
    t = F.col("event_type")
    s = _slots(spark, d).withColumns({
        "possession_group": F.when(t == "click", "home team").when(t == "view", "away team").when(t == "signup", "nobody"),
        "frames": F.when(F.col("origin_frame") % 3 != 0, 17), "covered": F.when(F.col("origin_frame") % 4 == 0, 17).otherwise(9),
    })
    return quality.play_block(s, BY).select(*BY, "samples", "home", "away", "unknown", F.round("home_fraction", 6).alias("home_fraction"), "play_stratum")


@query(sql("sp", "gp") + """, c AS (SELECT match_id, team, count(*) AS theoretical, count(CASE WHEN idx >= 5 THEN 1 END) AS complete, count(CASE WHEN idx >= 5 AND event_type <> 'view' THEN 1 END) AS pass,
  count(CASE WHEN idx >= 5 AND event_type = 'click' THEN 1 END) + CASE WHEN match_id = 4 THEN 1000000 ELSE 0 END AS scoreable FROM gp GROUP BY match_id, team)
SELECT match_id, team, 'scoreable_over_pass' AS problem FROM c WHERE scoreable > pass""")
def census_monotone(spark, d):
    p = X.gappy_players(spark, d)
    late = F.col("idx") >= 5
    c = stats.census(p, ["match_id", "team"], {
        "theoretical": F.count("*"), "complete": F.count_if(late), "pass": F.count_if(late & (F.col("event_type") != "view")), "scoreable": F.count_if(late & (F.col("event_type") == "click")),
    })
    c = c.where("depth = 0").withColumn("scoreable", F.col("scoreable") + F.when(F.col("match_id") == 4, 1000000).otherwise(0))
    return constraints.monotone(c, ["match_id", "team"], ["theoretical", "complete", "pass", "scoreable"])


@query(sql("sp") + " SELECT [12] AS missing, 7::BIGINT AS unexpected FROM (SELECT count(*) FROM sp)")
def drift_domain(spark, d):
    return constraints.complete_domain(X.sample_players(spark, d).select(F.col("match_id").cast("int").alias("match_id")), "match_id", [0, 1, 2, 12])


# --- rules of eligibility, one column each ---


@query("""SELECT o_orderkey AS id, array_to_string(CASE WHEN n <= 25 THEN ['INSUFFICIENT_HISTORY_SUPPORT'] WHEN n < 41 THEN ['INSUFFICIENT_FUTURE_SUPPORT'] WHEN n > 41 THEN ['WINDOW_SUPPORT_LENGTH_MISMATCH'] ELSE [] END, ',') AS codes
FROM (SELECT o_orderkey, o_orderkey % 60 AS n FROM orders)""")
def support_length_rules(spark, d):
    rules = eligibility.support_length(F.col("o_orderkey") % 60)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(eligibility.codes(**rules), ",").alias("codes"))


@query(sql("ph") + """ SELECT id, array_to_string(list_filter([CASE WHEN e % 3 = 0 THEN 'PHASE_INTERVAL_INVALID' END, CASE WHEN k % 7 = 0 THEN 'PHASE_MATCH_ID_MISMATCH' END, CASE WHEN period = 1995 THEN 'PHASE_SOURCE_IDENTITY_MISMATCH' END], lambda c: c IS NOT NULL), ',') AS codes FROM ph""")
def phase_rules(spark, d):
    p = X.phases(spark, d).select("id", F.col("k").alias("match_id"), F.when(F.col("k") % 7 != 0, F.col("k")).alias("phase_match_id"), F.col("s").alias("start"),
        F.when(F.col("e") % 3 == 0, F.col("s")).otherwise(F.col("e")).alias("end"), F.when(F.col("period") == 1995, "old").otherwise("now").alias("release_id"))
    return eligibility.phase_problems(p, "now").select("id", F.array_join("phase_codes", ",").alias("codes"))


@query("""WITH p AS (SELECT o_custkey AS match_id, o_orderkey % 3 AS period, o_orderkey % 50 AS s, o_orderkey % 50 + o_orderkey % 9 - 1 AS e FROM orders),
o AS (SELECT *, coalesce(s < lag(e) OVER w AND period <> lag(period) OVER w, false) AS ov FROM p WINDOW w AS (PARTITION BY match_id ORDER BY s, e, period)),
g AS (SELECT match_id, period, bool_or(s >= e) AS bad, bool_or(ov) AS ov, count(*) AS n, count(DISTINCT (s, e)) AS k FROM o GROUP BY ALL)
SELECT match_id, period, array_to_string(list_filter([CASE WHEN k > 1 OR ov THEN 'PERIOD_BOUNDS_CONFLICT' END, CASE WHEN n > k THEN 'PERIOD_BOUNDS_DUPLICATE' END, CASE WHEN bad THEN 'PERIOD_BOUNDS_INVALID' END], lambda c: c IS NOT NULL), ',') AS codes FROM g""")
def period_rules(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("match_id"), (k % 3).alias("period"), (k % 50).alias("start_frame"), (k % 50 + k % 9 - 1).alias("end_frame"))
    return eligibility.period_problems(p).select("match_id", "period", F.array_join("period_codes", ",").alias("codes"))


_PLAYERS = """, pl AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS n_same, event_id % 7 <> 0 AS team_ok, CASE WHEN event_id % 19 <> 0 THEN is_detected END AS is_detected,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE x END AS x, y, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 <> 0 END AS inside FROM sp)"""


@query(sql("sp") + _PLAYERS + """ SELECT event_id, CASE WHEN n_same > 1 THEN 'DUPLICATE_PLAYER_ID' WHEN NOT team_ok THEN 'PLAYER_TEAM_IDENTITY_CONFLICT' WHEN is_detected IS NULL THEN 'INVALID_DETECTION_FLAG'
  WHEN x IS NULL THEN 'PLAYER_COORDINATES_MISSING' WHEN isnan(x) THEN 'NONFINITE_COORDINATE' WHEN abs(x) > 105 OR abs(y) > 68 THEN 'COORDINATE_IMPLAUSIBLE' WHEN NOT inside THEN 'PLAYER_OUTSIDE_APPEARANCE'
  WHEN abs(x) > 52.5 OR abs(y) > 34 THEN 'PLAYER_POSITION_OUTSIDE_PITCH' ELSE 'valid' END AS disposition FROM pl""")
def player_rules(spark, d):
    i = F.col("event_id")
    p = X.sample_players(spark, d).withColumns({
        "n_same": F.when(i % 11 == 0, 2).otherwise(1), "team_ok": i % 7 != 0, "is_detected": F.when(i % 19 != 0, F.col("is_detected")),
        "x": F.when(i % 13 == 0, F.lit(None)).when(i % 17 == 0, F.lit(float("nan"))).otherwise(F.col("x")), "in_appearance": F.when(i % 3 != 0, i % 5 != 0),
        "pitch_length": F.lit(105.0), "pitch_width": F.lit(68.0),
    })
    return p.select("event_id", eligibility.player_disposition().alias("disposition"))


@query(sql("sp") + """ SELECT event_id, array_to_string(list_filter([CASE WHEN idx % 2 <> 0 OR event_id % 10 = 0 THEN 'CANONICAL_FRAME_MISMATCH' END, CASE WHEN event_id % 9 = 0 THEN 'INVALID_SAMPLE_SCHEMA' END,
  CASE WHEN event_id % 8 <> 0 AND (idx < 10 OR idx >= 60) THEN 'OUTSIDE_PERIOD_BOUNDS' END, CASE WHEN event_id % 8 = 0 THEN 'PERIOD_BOUNDS_MISSING' END, CASE WHEN event_type = 'error' THEN 'TIMESTAMP_MISSING' END], lambda c: c IS NOT NULL), ',') AS codes FROM sp""")
def sample_rules(spark, d):
    i = F.col("event_id")
    s = X.sample_players(spark, d).select("event_id", F.lit(True).alias("present"), F.when(i % 9 != 0, F.lit(1)).alias("period"), F.col("idx").alias("frame"),
        (F.floor(F.col("idx") / 2) + F.when(i % 10 == 0, 1).otherwise(0)).alias("idx"), F.when(i % 8 != 0, F.lit(10)).alias("start_frame"), F.when(i % 8 != 0, F.lit(60)).alias("end_frame"),
        F.when(F.col("event_type") != "error", F.col("idx")).alias("clock"))
    return eligibility.slot_codes(s).select("event_id", F.array_join("slot_codes", ",").alias("codes"))


@query(sql("sp") + """, b AS (SELECT event_id, event_id % 9 <> 0 AS has, CASE WHEN event_id % 9 <> 0 AND event_type <> 'view' THEN true END AS flag, CASE WHEN event_id % 9 <> 0 AND event_type <> 'signup' THEN x END AS bx, CASE WHEN event_id % 9 <> 0 AND event_id % 4 <> 0 THEN y END AS by_,
  CASE WHEN event_type <> 'click' THEN 'home team' END AS g, CASE WHEN event_type = 'error' THEN player_id END AS p, event_id % 2 = 0 AS seen FROM sp)
SELECT event_id, array_to_string(list_filter([CASE WHEN NOT has OR bx IS NULL AND by_ IS NULL THEN 'BALL_COORDINATES_MISSING' END, CASE WHEN has AND (bx IS NULL) <> (by_ IS NULL) THEN 'BALL_COORDINATES_PARTIAL' END,
  CASE WHEN has AND flag IS NULL THEN 'BALL_DETECTION_UNKNOWN' END, CASE WHEN NOT has THEN 'BALL_OBJECT_ABSENT' END, CASE WHEN has AND (abs(bx) > 52.5 OR abs(by_) > 34) THEN 'BALL_OUTSIDE_PITCH' END,
  CASE WHEN g IS NULL THEN 'POSSESSION_CONTEXT_UNKNOWN' END, CASE WHEN p IS NOT NULL AND NOT seen THEN 'POSSESSION_PLAYER_UNOBSERVED' END], lambda c: c IS NOT NULL), ',') AS codes FROM b""")
def slot_warnings(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    has = i % 9 != 0
    s = X.sample_players(spark, d).select("event_id", F.lit(True).alias("present"), has.alias("ball_present"), F.when(has & (t != "view"), F.lit(True)).alias("ball_flag"), F.when(has & (t != "signup"), F.col("x")).alias("ball_x"),
        F.when(has & (i % 4 != 0), F.col("y")).alias("ball_y"), F.lit(105.0).alias("pitch_length"), F.lit(68.0).alias("pitch_width"), F.when(t != "click", "home team").alias("possession_group"),
        F.when(t == "error", F.col("player_id")).alias("possession_player"), (i % 2 == 0).alias("possession_observed"))
    return eligibility.slot_warnings(s).select("event_id", F.array_join("slot_warnings", ",").alias("codes"))


@query(sql("sp", "gp") + _QS + """, l AS (SELECT *, present AND coalesce(lag(present) OVER w, false) AS both_, period <> lag(period) OVER w AS cr, idx + CASE WHEN idx % 13 = 0 THEN -3 ELSE 0 END AS di FROM sl WINDOW w AS (PARTITION BY player_id, origin_frame ORDER BY slot)),
m AS (SELECT *, di - lag(di) OVER w AS d FROM l WINDOW w AS (PARTITION BY player_id, origin_frame ORDER BY slot)),
g AS (SELECT player_id, origin_frame, coalesce(bool_or(both_ AND cr), false) AS c, coalesce(bool_or(both_ AND NOT cr AND d = 0), false) AS du, coalesce(bool_or(both_ AND NOT cr AND d < 0), false) AS no, coalesce(bool_or(NOT present OR both_ AND NOT cr AND d > 1), false) AS ga,
  coalesce(bool_or(both_ AND NOT cr AND d * 2 <> 2), false) AS ti FROM m GROUP BY ALL)
SELECT player_id, origin_frame, array_to_string(list_filter([CASE WHEN du THEN 'DUPLICATE_SAMPLE' END, CASE WHEN no THEN 'NONMONOTONIC_SAMPLE_ORDER' END, CASE WHEN c THEN 'PERIOD_BOUNDARY_CROSSED' END, CASE WHEN ga THEN 'TEMPORAL_GAP' END, CASE WHEN ti THEN 'TIMESTAMP_DISCONTINUITY' END], lambda c: c IS NOT NULL), ',') AS codes,
  NOT (c OR du OR no OR ga OR ti) AS eligible FROM g""")
def pair_rules(spark, d):
    """The rules between neighbouring slots, and the early-exit form of all of them at once."""
    s = _slots(spark, d).withColumn("idx", F.col("idx") + F.when(F.col("idx") % 13 == 0, -3).otherwise(0)).withColumn("clock", F.col("idx") * 2)
    s = eligibility.adjacency(s, BY)
    return eligibility.compact(s, BY, ["pair_codes"]).select(*BY, F.array_join("codes", ",").alias("codes"), "eligible")


@query("""SELECT n_nationkey AS match_id, n_nationkey > 0 AND n_regionkey <> 2 AND n_nationkey % 5 <> 0 AS metadata_ok FROM nation""")
def metadata_rule(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    m = table(spark, d, "nation").select(n.cast("long").alias("match_id"), F.lit(7).alias("home"), F.when(r == 2, 7).otherwise(8).alias("away"),
        F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(105.0)).alias("pitch_length"), F.lit(68.0).alias("pitch_width"))
    return eligibility.metadata_problems(m).select("match_id", "metadata_ok")


@query(sql("tg") + """, c AS (SELECT target % 8 AS channel, truth, vec_id % 3 <> 0 AS region FROM tg)
SELECT channel, round(sqrt(avg((0.9::DOUBLE * truth - truth) ** 2)) / stddev_pop(truth), 6) AS sre, count(*) AS n, count(*) >= 256 AS enough FROM c WHERE region GROUP BY channel""")
def region_channels(spark, d):
    t = X.targets(spark, d).select((F.col("target") % 8).alias("channel"), "truth", (F.col("truth") * 0.9).alias("prediction"), (F.col("vec_id") % 3 != 0).alias("region"))
    return scoring.channel_errors(t, "channel", "prediction", "truth", "region").select("channel", F.round("sre", 6).alias("sre"), "n", "enough")


@query(sql("ph") + """ SELECT k, array_to_string(list_transform(list_sort(list({'p': period, 's': s, 'e': e})), lambda x: x.p || '/' || x.s || '/' || x.e), ' ') AS phases FROM ph GROUP BY k""")
def sorted_phases(spark, d):
    p = intervals.in_order(X.phases(spark, d), ["k"], "period", "s", "e")
    return p.select("k", F.array_join(F.transform("intervals", lambda x: F.concat_ws("/", x["period"].cast("string"), x["s"].cast("string"), x["e"].cast("string"))), " ").alias("phases"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS v, round(value / nullif(event_id % 4, 0), 6) AS ratio FROM events")
def comparison_values(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.lit(float("nan"))).when(i % 5 == 0, F.lit(-0.0)).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", arrays.dropped_nan(raw).alias("v"), F.round(safe_ratio("value", i % 4), 6).alias("ratio"))




# --- the whole producer: raw frames to windows ---


def _raw_matches(spark, d):
    """Each user is a match whose events are its frames (with gaps where one is an error), fourteen players and faults by event id."""
    i, t, n = F.col("event_id"), F.col("event_type"), F.col("idx")
    f = X.gappy_players(spark, d).select((F.col("player_id") + 1).alias("match_id"), "event_id", "event_type", "idx", "frame", "x", "y")
    # what is done with a match's frames, their players within them, is done where they lie: none of it is shuffled
    f = f.repartition(X.parts(table(spark, d, "events"), 100_000), "match_id")

    def player(k):
        x = F.when((k == 1) & (i % 41 == 0), 200.0).when((k == 14) & (i % 47 == 0), 60.0).otherwise(2.0 * k + 0.01 * F.col("frame"))
        return F.struct(k.cast("long").alias("player_id"), F.when(~((k == 2) & (i % 43 == 0)), x).alias("x"), k.cast("double").alias("y"), F.lit(True).alias("is_detected"))

    c = F.col("frame")
    clock = F.format_string("%02d:%02d:%02d.%02d", F.floor(c / 36000), F.floor(c / 600) % 60, F.floor(c / 10) % 60, (c % 10) * 10)
    ball = F.struct(F.when(t != "signup", F.col("x") / 4).alias("x"), (F.col("y") / 2.0).alias("y"), F.lit(0.0).alias("z"), F.when(t != "click", F.lit(True)).alias("is_detected"))
    frames = f.select(
        "match_id", "frame", F.when(~((t == "signup") & (n % 9 == 0)), clock).alias("timestamp"), F.when(n < 40, 1).otherwise(2).alias("period"), F.when(t != "purchase", ball).alias("ball_data"),
        F.struct(F.when(t != "view", "home team").alias("group"), F.when(t == "click", F.lit(14).cast("long")).alias("player_id")).alias("possession"),
        F.transform(F.sequence(F.lit(1), F.when(i % 50 == 0, 12).otherwise(14)), player).alias("player_data"),
    )
    ids = f.select("match_id").distinct()
    m = F.col("match_id")
    matches = ids.select("match_id", F.lit(100).cast("long").alias("home"), F.when((m - 1) % 7 == 0, 100).otherwise(200).cast("long").alias("away"), F.lit(105.0).alias("pitch_length"), F.lit(68.0).alias("pitch_width"))
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long")))
    roster = ids.select("match_id", k.alias("player_id"))
    roster = roster.withColumns({"team_id": F.when(F.col("player_id") <= 7, 100).otherwise(F.when((F.col("match_id") - 1) % 7 == 0, 100).otherwise(200)).cast("long"), "group": F.when(F.col("player_id") <= 7, "home team").otherwise("away team")})
    last = F.when((F.col("player_id") == 3) & ((F.col("match_id") - 1) % 5 == 1), 60).otherwise(79).cast("long")
    spans = F.array(F.struct(F.lit(1).alias("period"), F.lit(0).cast("long").alias("start_frame"), last.alias("end_frame")), F.struct(F.lit(2).alias("period"), F.lit(80).cast("long").alias("start_frame"), F.lit(100000).cast("long").alias("end_frame")))
    appearances = roster.select("match_id", "player_id", F.inline(spans))
    bounds = F.array(*[F.struct(F.lit(a).alias("period"), F.lit(b).cast("long").alias("start_frame"), F.lit(c).cast("long").alias("end_frame")) for a, b, c in ((1, 0, 80), (2, 80, 130))])
    periods = ids.select("match_id", F.inline(bounds))
    plays = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 50), (50, 110))])
    phases = ids.select("match_id", F.inline(plays))
    return frames, matches, roster, periods, appearances, phases


def _produced(h: int, f: int) -> str:
    """SQL of the windows of h + 1 + f slots: r has all codes of a window, ws the names of warnings."""
    return """, s AS (SELECT player_id AS m, frame AS f, idx, event_id AS e, event_type AS t, CASE WHEN idx < 40 THEN 1 ELSE 2 END AS period, CASE WHEN NOT (event_type = 'signup' AND idx % 9 = 0) THEN frame END AS clock,
  event_type <> 'purchase' AS has, CASE WHEN event_type NOT IN ('purchase', 'signup') THEN x / 4 END AS bx, CASE WHEN event_type <> 'purchase' THEN y / 2 END AS by_,
  event_id % 41 = 0 AS far, event_id % 43 = 0 AS lost, player_id % 5 = 1 AND idx < 40 AND frame > 60 AS out3, event_id % 50 = 0 AS few FROM gp),
l AS (SELECT *, lag(f) OVER w AS lf, period <> lag(period) OVER w AS crossed, f - lag(f) OVER w AS df, clock - lag(clock) OVER w AS dc, bx - lag(bx) OVER w AS dx, by_ - lag(by_) OVER w AS dy,
  (far, lost, out3, few) <> (lag(far) OVER w, lag(lost) OVER w, lag(out3) OVER w, lag(few) OVER w) AS changed, NOT few AND NOT lag(few) OVER w AND (e % 47 = 0) <> (lag(e) OVER w % 47 = 0) AS jumped FROM s WINDOW w AS (PARTITION BY m ORDER BY f)),
c AS (SELECT m, f, idx, (bx IS NOT NULL) AS ok, list_filter([
    CASE WHEN far THEN 'COORDINATE_IMPLAUSIBLE' END, CASE WHEN lost THEN 'PLAYER_COORDINATES_MISSING' END, CASE WHEN out3 THEN 'PLAYER_OUTSIDE_APPEARANCE' END, CASE WHEN NOT few AND e % 47 = 0 THEN 'PLAYER_POSITION_OUTSIDE_PITCH' END,
    CASE WHEN far OR lost OR out3 OR few THEN 'PLAYER_COUNT_BELOW_TEAM_MINIMUM' END, CASE WHEN few THEN 'PLAYER_OBSERVATION_MISSING' END, CASE WHEN clock IS NULL THEN 'TIMESTAMP_MISSING' END,
    CASE WHEN f >= 130 OR f < 80 AND period = 2 OR f >= 80 AND period = 1 THEN 'OUTSIDE_PERIOD_BOUNDS' END, CASE WHEN m % 7 = 0 THEN 'INVALID_MATCH_METADATA' END,
    CASE WHEN NOT has THEN 'BALL_OBJECT_ABSENT' END, CASE WHEN t = 'click' THEN 'BALL_DETECTION_UNKNOWN' END, CASE WHEN t = 'signup' THEN 'BALL_COORDINATES_PARTIAL' END, CASE WHEN NOT has THEN 'BALL_COORDINATES_MISSING' END,
    CASE WHEN has AND (abs(bx) > 52.5 OR abs(by_) > 34) THEN 'BALL_OUTSIDE_PITCH' END, CASE WHEN t = 'view' THEN 'POSSESSION_CONTEXT_UNKNOWN' END, CASE WHEN t = 'click' AND few THEN 'POSSESSION_PLAYER_UNOBSERVED' END, 'SOURCE_QUALITY_UNKNOWN'], lambda x: x IS NOT NULL) AS own,
  list_filter([CASE WHEN crossed THEN 'PERIOD_BOUNDARY_CROSSED' END, CASE WHEN NOT crossed AND df > 2 THEN 'TEMPORAL_GAP' END, CASE WHEN NOT crossed AND dc <> 2 THEN 'TIMESTAMP_DISCONTINUITY' END, CASE WHEN NOT crossed AND changed THEN 'IDENTITY_TRANSITION_EXPOSURE' END,
    CASE WHEN NOT crossed AND df = 2 AND dc = 2 AND jumped THEN 'PLAYER_DISPLACEMENT_OUTLIER' END, CASE WHEN NOT crossed AND df = 2 AND sqrt(dx * dx + dy * dy) / 0.2 > 50 THEN 'BALL_DISPLACEMENT_OUTLIER' END], lambda x: x IS NOT NULL) AS pair FROM l),
o AS (SELECT m, unnest(range(0, 130, 2)) AS o FROM (SELECT DISTINCT m FROM s)), k AS (SELECT unnest(range(-:h, :f + 1)) AS k),
sl AS (SELECT o.m, o.o, k, c.f IS NOT NULL AS present, coalesce(ok, false) AS ok, CASE WHEN c.f IS NULL THEN ['TEMPORAL_GAP'] WHEN k > -:h THEN list_concat(own, pair) ELSE own END AS codes FROM o CROSS JOIN k LEFT JOIN c ON c.m = o.m AND c.f = o.o + 2 * k),
g AS (SELECT m, o, list_distinct(flatten(list(codes))) AS x, bool_or(k = 0 AND ok) AS at0, count(CASE WHEN ok THEN 1 END) / (:h + :f + 1)::DOUBLE AS fr FROM sl GROUP BY ALL),
r AS (SELECT m, o, list_concat(x, list_filter([CASE WHEN NOT at0 THEN 'BALL_MISSING_AT_ORIGIN' END, CASE WHEN fr < 0.95 THEN 'BALL_COVERAGE_BELOW_MINIMUM' END, CASE WHEN o - 2 * :h < 0 OR o + 2 * :f >= 110 THEN 'PHASE_NOT_IN_PLAY_OR_UNKNOWN' END], lambda y: y IS NOT NULL)) AS x FROM g),
w AS (SELECT unnest(['PLAYER_APPEARANCE_METADATA_UNKNOWN', 'PLAYER_COORDINATES_MISSING', 'PLAYER_OUTSIDE_APPEARANCE', 'PLAYER_POSITION_OUTSIDE_PITCH', 'PLAYER_OBSERVATION_MISSING', 'BALL_OBJECT_ABSENT', 'BALL_DETECTION_UNKNOWN', 'BALL_COORDINATES_PARTIAL', 'BALL_COORDINATES_MISSING',
  'BALL_OUTSIDE_PITCH', 'POSSESSION_CONTEXT_UNKNOWN', 'POSSESSION_PLAYER_UNOBSERVED', 'IDENTITY_TRANSITION_EXPOSURE', 'PLAYER_DISPLACEMENT_OUTLIER', 'BALL_DISPLACEMENT_OUTLIER', 'SOURCE_QUALITY_UNKNOWN']) AS c),
ws AS (SELECT list(c) AS ws FROM w)""".replace(":h", str(h)).replace(":f", str(f))


@query(sql("sp", "gp") + _produced(5, 3) + """ SELECT m + 1 AS match_id, o AS origin_frame, array_to_string(list_sort(list_filter(x, lambda c: NOT list_contains(ws, c))), ',') AS exclusions, array_to_string(list_sort(list_filter(x, lambda c: list_contains(ws, c))), ',') AS warnings,
  len(list_filter(x, lambda c: NOT list_contains(ws, c))) = 0 AS eligible FROM r, ws""")
def produced_windows(spark, d):
    found, _ = population.produce(*_raw_matches(spark, d), NINE)
    return found.select("match_id", "origin_frame", F.array_join("exclusion_reasons", ",").alias("exclusions"), F.array_join(F.array_sort("warnings"), ",").alias("warnings"), "eligible")


@query(sql("sp", "gp") + _produced(1, 1) + """, el AS (SELECT m, o FROM r, ws WHERE len(list_filter(x, lambda c: NOT list_contains(ws, c))) = 0)
SELECT m + 1 AS match_id, o AS origin_frame, player_id, round(sum(x), 6) AS sum_x, count(*) AS n_truth FROM (
  SELECT el.m, el.o, p AS player_id, CASE WHEN p = 14 AND s.e % 47 = 0 THEN 60.0 ELSE 2 * p + 0.01 * s.f END::DOUBLE AS x FROM el CROSS JOIN (SELECT unnest(range(1, 15)) AS p) JOIN s ON s.m = el.m AND s.f = el.o + 2) GROUP BY ALL""")
def produced_truth(spark, d):
    _, panel = population.produce(*_raw_matches(spark, d), Params(history=1, future=1))
    return panel.groupBy("match_id", "origin_frame", "player_id").agg(F.round(F.sum("truth_x"), 6).alias("sum_x"), F.count("truth_x").alias("n_truth"))
