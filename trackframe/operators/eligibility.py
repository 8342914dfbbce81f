"""Window eligibility: exclusions and warnings over slots, as columns and sorted code arrays.

A window is its slots (slot -history..future) joined to samples; rules are evaluated on slots and
players with an ordered disposition, then aggregated to the window in one pass for each grain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import implausible, in_pitch, is_finite
from ..params import DEFAULTS, Params

EXCLUSIONS = (
    "INSUFFICIENT_HISTORY_SUPPORT", "INSUFFICIENT_FUTURE_SUPPORT", "WINDOW_SUPPORT_LENGTH_MISMATCH", "INVALID_MATCH_METADATA",
    "PHASE_SOURCE_IDENTITY_MISMATCH", "PHASE_INTERVAL_INVALID", "PHASE_MATCH_ID_MISMATCH", "TEMPORAL_GAP", "INVALID_SAMPLE_SCHEMA",
    "CANONICAL_FRAME_MISMATCH", "PERIOD_BOUNDS_MISSING", "PERIOD_BOUNDS_INVALID", "PERIOD_BOUNDS_DUPLICATE", "PERIOD_BOUNDS_CONFLICT",
    "OUTSIDE_PERIOD_BOUNDS", "TIMESTAMP_MISSING", "DUPLICATE_PLAYER_ID", "PLAYER_TEAM_IDENTITY_CONFLICT", "INVALID_DETECTION_FLAG",
    "COORDINATE_IMPLAUSIBLE", "NONFINITE_COORDINATE", "PLAYER_COUNT_BELOW_TEAM_MINIMUM", "PERIOD_BOUNDARY_CROSSED", "DUPLICATE_SAMPLE",
    "NONMONOTONIC_SAMPLE_ORDER", "TIMESTAMP_DISCONTINUITY", "PHASE_NOT_IN_PLAY_OR_UNKNOWN", "BALL_MISSING_AT_ORIGIN", "BALL_COVERAGE_BELOW_MINIMUM",
)
WARNINGS = (
    "PLAYER_APPEARANCE_METADATA_UNKNOWN", "PLAYER_COORDINATES_MISSING", "PLAYER_OUTSIDE_APPEARANCE", "PLAYER_POSITION_OUTSIDE_PITCH",
    "PLAYER_OBSERVATION_MISSING", "BALL_OBJECT_ABSENT", "BALL_DETECTION_UNKNOWN", "BALL_COORDINATES_PARTIAL", "BALL_COORDINATES_MISSING",
    "BALL_OUTSIDE_PITCH", "POSSESSION_CONTEXT_UNKNOWN", "POSSESSION_PLAYER_UNOBSERVED", "IDENTITY_TRANSITION_EXPOSURE",
    "PLAYER_DISPLACEMENT_OUTLIER", "BALL_DISPLACEMENT_OUTLIER", "SOURCE_QUALITY_UNKNOWN",
)


def any_of(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def codes(**rules: Column) -> Column:
    """Sorted array of the names of the rules that fire."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def support_length(n: Column, p: Params = DEFAULTS) -> dict[str, Column]:
    return {
        "INSUFFICIENT_HISTORY_SUPPORT": n <= p.history,
        "INSUFFICIENT_FUTURE_SUPPORT": (n > p.history) & (n < p.slots),
        "WINDOW_SUPPORT_LENGTH_MISMATCH": n > p.slots,
    }


def metadata_problems(matches: DataFrame) -> DataFrame:
    """Adds metadata_ok for rows (match_id, home, away, pitch_length, pitch_width)."""
    ok = (F.col("match_id") > 0) & (F.col("home") > 0) & (F.col("away") > 0) & (F.col("home") != F.col("away"))
    ok &= is_finite("pitch_length") & is_finite("pitch_width") & (F.col("pitch_length") > 0) & (F.col("pitch_width") > 0)
    return matches.withColumn("metadata_ok", F.coalesce(ok, F.lit(False)))


def phase_problems(phases: DataFrame, release: str) -> DataFrame:
    """Codes of each phase row (match_id of the window's match, phase_match_id, release_id, start, end)."""
    return phases.withColumn(
        "phase_codes",
        codes(
            PHASE_SOURCE_IDENTITY_MISMATCH=~F.col("release_id").eqNullSafe(F.lit(release)),
            PHASE_INTERVAL_INVALID=F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end")),
            PHASE_MATCH_ID_MISMATCH=~F.col("phase_match_id").eqNullSafe(F.col("match_id")),
        ),
    )


def roster_known(roster: DataFrame, appearances: DataFrame) -> DataFrame:
    """match_id, roster_known: whether ids are whole, no player is listed twice and all appearances are
    intervals of a period. Matches without a roster have no row."""
    whole = F.coalesce((F.col("player_id") > 0) & (F.col("team_id") > 0), F.lit(False))
    r = roster.groupBy("match_id").agg((F.bool_and(whole) & (F.count("*") == F.count_distinct("player_id"))).alias("ok"))
    bad = F.coalesce(F.col("start_frame") > F.col("end_frame"), F.lit(True)) | F.col("period").isNull()
    a = appearances.groupBy("match_id").agg(any_of(bad).alias("bad"))
    return r.join(a, "match_id", "left").select("match_id", (F.col("ok") & ~F.coalesce("bad", F.lit(False))).alias("roster_known"))


def roster_whole(roster: str, appearances: str) -> Column:
    """roster_known() of arrays of a match's rows; null without a roster."""
    ids = F.transform(roster, lambda x: x["player_id"])
    whole = F.forall(roster, lambda x: F.coalesce((x["player_id"] > 0) & (x["team_id"] > 0), F.lit(False)))
    bad = F.exists(appearances, lambda x: F.coalesce(x["start_frame"] > x["end_frame"], F.lit(True)) | x["period"].isNull())
    return F.when(F.size(roster) > 0, whole & (F.size(F.array_distinct(ids)) == F.size(ids)) & ~bad)


def period_problems(periods: DataFrame) -> DataFrame:
    """match_id, period, period_codes of bounds (match_id, period, start_frame, end_frame)."""
    w = Window.partitionBy("match_id").orderBy("start_frame", "end_frame", "period")
    overlap = (F.col("start_frame") < F.lag("end_frame").over(w)) & (F.col("period") != F.lag("period").over(w))
    p = periods.withColumn("bad", F.coalesce(F.col("start_frame") >= F.col("end_frame"), F.lit(True))).withColumn("overlap", F.coalesce(overlap, F.lit(False)))
    kinds = F.count_distinct("start_frame", "end_frame")
    p = p.groupBy("match_id", "period").agg(any_of(F.col("bad")).alias("bad"), any_of(F.col("overlap")).alias("overlap"), F.count("*").alias("n"), kinds.alias("kinds"))
    return p.select(
        "match_id", "period",
        codes(PERIOD_BOUNDS_INVALID=F.col("bad"), PERIOD_BOUNDS_DUPLICATE=(F.col("n") > F.col("kinds")), PERIOD_BOUNDS_CONFLICT=(F.col("kinds") > 1) | F.col("overlap")).alias("period_codes"),
    )


def adjacency(slots: DataFrame, by: list[str]) -> DataFrame:
    """Adds pair_codes: what is wrong between a slot and the one before. Rows need slot, present,
    period, idx, frame, clock. After a change of period the other checks of that pair are skipped."""
    w = Window.partitionBy(*by).orderBy("slot")

    def d(c):
        return F.col(c) - F.lag(c).over(w)

    both = F.col("present") & F.lag("present").over(w)
    crossed = both & (F.col("period") != F.lag("period").over(w))
    near = both & ~F.coalesce(crossed, F.lit(False))
    return slots.withColumn(
        "pair_codes",
        codes(
            TEMPORAL_GAP=~F.col("present") | near & ((d("idx") > 1) | (d("frame") > 2)),
            PERIOD_BOUNDARY_CROSSED=crossed,
            DUPLICATE_SAMPLE=near & ((d("idx") == 0) | (d("frame") == 0)),
            NONMONOTONIC_SAMPLE_ORDER=near & ((d("idx") < 0) | (d("frame") < 0)),
            TIMESTAMP_DISCONTINUITY=near & (d("clock") != 2),
        ),
    )


def slot_codes(slots: DataFrame) -> DataFrame:
    """Adds slot_codes of present slots (columns period, start_frame, end_frame of the joined bounds)."""
    here = F.col("present")
    return slots.withColumn(
        "slot_codes",
        codes(
            INVALID_SAMPLE_SCHEMA=here & F.col("period").isNull(),
            CANONICAL_FRAME_MISMATCH=here & ((F.col("frame") % 2 != 0) | (F.col("idx") != F.floor(F.col("frame") / 2))),
            PERIOD_BOUNDS_MISSING=here & F.col("start_frame").isNull(),
            OUTSIDE_PERIOD_BOUNDS=here & ((F.col("frame") < F.col("start_frame")) | (F.col("frame") >= F.col("end_frame"))),
            TIMESTAMP_MISSING=here & F.col("clock").isNull(),
        ),
    )


def player_disposition(p: Params = DEFAULTS, col: Callable[[str], Column] = F.col) -> Column:
    """First reason why a player's row doesn't count, in the order of the checks; valid otherwise.

    Columns: n_same (rows of the player in the sample), team_ok, is_detected, x, y, pitch_length,
    pitch_width, in_appearance (null: unknown); col gives each by its name."""
    x, y = col("x"), col("y")
    missing = x.isNull() | y.isNull()
    return (
        F.when(col("n_same") > 1, "DUPLICATE_PLAYER_ID")
        .when(~F.coalesce(col("team_ok"), F.lit(False)), "PLAYER_TEAM_IDENTITY_CONFLICT")
        .when(col("is_detected").isNull(), "INVALID_DETECTION_FLAG")
        .when(missing, "PLAYER_COORDINATES_MISSING")
        .when(~is_finite(x) | ~is_finite(y), "NONFINITE_COORDINATE")
        .when(implausible(x, y, col("pitch_length"), col("pitch_width"), p.player_factor), "COORDINATE_IMPLAUSIBLE")
        .when(F.coalesce(~col("in_appearance"), F.lit(False)), "PLAYER_OUTSIDE_APPEARANCE")
        .when(~in_pitch(x, y, col("pitch_length"), col("pitch_width")), "PLAYER_POSITION_OUTSIDE_PITCH")
        .otherwise("valid")
    )


COUNTED = ("valid", "PLAYER_POSITION_OUTSIDE_PITCH")


def team_minimum(players: DataFrame, by: list[str], teams: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """by, team_ok_min: whether both teams have enough counted players (teams: by x group)."""
    n = players.where(F.col("disposition").isin(*COUNTED)).groupBy(*by, "group").agg(F.count("*").alias("n"))
    full = teams.join(n, [*by, "group"], "left")
    return full.groupBy(*by).agg((F.min(F.coalesce("n", F.lit(0))) >= p.min_players).alias("team_ok_min"))


def ball_rules(slots: DataFrame, by: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Window-level ball coverage: ball_ok slots (finite and plausible; version 1 divides by present
    slots, version 2 by all)."""
    ok = F.coalesce(F.col("ball_ok"), F.lit(False))
    total = F.lit(p.slots) if p.version == 2 else F.count_if("present")
    out = slots.groupBy(*by).agg(F.count_if(ok).alias("ball_slots"), any_of(ok & (F.col("slot") == 0)).alias("ball_at_origin"), F.try_divide(F.count_if(ok).cast("double"), total).alias("ball_fraction"))
    return out.withColumn("ball_codes", codes(BALL_MISSING_AT_ORIGIN=~F.col("ball_at_origin"), BALL_COVERAGE_BELOW_MINIMUM=F.coalesce(F.col("ball_fraction") < p.ball_fraction, F.lit(True))))


def slot_warnings(slots: DataFrame) -> DataFrame:
    """Adds ball and possession warnings of present slots (ball_x, ball_y, ball_flag, ball_present,
    pitch_length, pitch_width, possession_group, possession_player, possession_observed)."""
    here, b = F.col("present"), F.col("ball_present")
    x, y = F.col("ball_x"), F.col("ball_y")
    return slots.withColumn(
        "slot_warnings",
        codes(
            BALL_OBJECT_ABSENT=here & ~b,
            BALL_DETECTION_UNKNOWN=here & b & F.col("ball_flag").isNull(),
            BALL_COORDINATES_PARTIAL=here & b & (x.isNull() != y.isNull()),
            BALL_COORDINATES_MISSING=here & (~b | x.isNull() & y.isNull()),
            BALL_OUTSIDE_PITCH=here & b & ~in_pitch(x, y, "pitch_length", "pitch_width"),
            POSSESSION_CONTEXT_UNKNOWN=here & F.col("possession_group").isNull(),
            POSSESSION_PLAYER_UNOBSERVED=here & F.col("possession_player").isNotNull() & ~F.coalesce("possession_observed", F.lit(False)),
        ),
    )


def windows(slots: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """by, exclusion_reasons, warnings, eligible: the distinct codes of all slots of a window."""
    found = F.flatten(F.collect_set(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))
    every = F.array_sort(F.array_distinct(found))
    out = slots.groupBy(*by).agg(every.alias("every"))
    bad = F.filter("every", lambda c: c.isin(*EXCLUSIONS))
    return out.select(*by, bad.alias("exclusion_reasons"), F.filter("every", lambda c: c.isin(*WARNINGS)).alias("warnings"), (F.size(bad) == 0).alias("eligible"))


def judged(slots: DataFrame, by: list[str], arrays: list[str], p: Params = DEFAULTS) -> DataFrame:
    """windows() and ball_rules() in one aggregation: by, exclusion_reasons (with those of the ball), warnings, eligible, ball_fraction."""
    ok = F.coalesce(F.col("ball_ok"), F.lit(False))
    total = F.lit(p.slots) if p.version == 2 else F.count_if("present")
    every = F.array_distinct(F.flatten(F.collect_set(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))))
    out = slots.groupBy(*by).agg(every.alias("every"), any_of(ok & (F.col("slot") == 0)).alias("at_origin"), F.try_divide(F.count_if(ok).cast("double"), total).alias("ball_fraction"))
    ball = codes(BALL_MISSING_AT_ORIGIN=~F.col("at_origin"), BALL_COVERAGE_BELOW_MINIMUM=F.coalesce(F.col("ball_fraction") < p.ball_fraction, F.lit(True)))
    bad = F.array_sort(F.array_union(F.filter("every", lambda c: c.isin(*EXCLUSIONS)), ball))
    out = out.select(*by, bad.alias("exclusion_reasons"), F.array_sort(F.filter("every", lambda c: c.isin(*WARNINGS))).alias("warnings"), "ball_fraction")
    return out.withColumn("eligible", F.size("exclusion_reasons") == 0)


def compact(slots: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """by, codes, eligible: all distinct codes of a window, and whether there is none of the exclusions; one pass, for slots whose codes are joined already."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))))
    fires = F.arrays_overlap(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), F.array(*[F.lit(c) for c in EXCLUSIONS]))
    return slots.groupBy(*by).agg(found.alias("codes"), (~any_of(fires)).alias("eligible"))


def issues(slots: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """by, issues: distinct (sample_index, code), null index first, then by index and code."""
    rows = F.transform(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda c: F.struct(F.coalesce(F.col("idx"), F.lit(-1)).alias("sample_index"), c.alias("code")))
    return slots.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(rows)))).alias("issues"))
