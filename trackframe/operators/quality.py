"""Quality blocks of windows: counters, fractions and strata of ball, players, time and play."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import in_pitch, is_finite, safe_ratio
from ..params import DEFAULTS, Params

#: States of a ball's coordinates, and its flag's values, for the cross-tabulation.
STATES = ("both_finite", "partial", "missing", "nonfinite")
FLAGS = ("true", "false", "null")


def coordinate_state(x: str, y: str) -> Column:
    a, b = F.col(x), F.col(y)
    return (
        F.when(a.isNull() & b.isNull(), "missing").when(a.isNull() | b.isNull(), "partial")
        .when(is_finite(x) & is_finite(y), "both_finite").otherwise("nonfinite")
    )


def three_way(part: Column, whole: Column, known: Column, all_: str, none: str, some: str) -> Column:
    """unknown, all_, none or some: how much of the whole has a property."""
    return F.when(~known | (whole == 0), "unknown").when(part == whole, all_).when(part == 0, none).otherwise(some)


def ball_block(slots: DataFrame, by: Sequence[str], p: Params = DEFAULTS) -> DataFrame:
    """Counters of the ball in each window of slots (present, ball_present, ball_flag, ball_x, ball_y, pitch_length, pitch_width).

    Every slot is one of: missing sample, absent ball, or a flag's value by a state of coordinates; ``reconciles`` tells
    whether these counts sum to the expected slots."""
    here = F.col("present") & F.col("ball_present")
    flag = F.when(F.col("ball_flag").isNull(), "null").when(F.col("ball_flag"), "true").otherwise("false")
    state = coordinate_state("ball_x", "ball_y")
    counts = [F.count_if(here & (flag == f) & (state == s)).alias(f"{f}_{s}") for f in FLAGS for s in STATES]
    outside = here & (state == "both_finite") & ~in_pitch("ball_x", "ball_y", "pitch_length", "pitch_width")
    out = slots.groupBy(*by).agg(
        *counts, F.count("*").alias("slots"), F.count_if(~F.col("present")).alias("missing_samples"),
        F.count_if(F.col("present") & ~F.col("ball_present")).alias("absent_objects"), F.count_if(outside).alias("outside_pitch"),
    )
    total = lambda flags, states: sum((F.col(f"{f}_{s}") for f in flags for s in states), F.lit(0))
    out = out.withColumns({
        "valid_positions": total(FLAGS, ("both_finite",)), "known_flags": total(("true", "false"), STATES), "flag_true": total(("true",), STATES),
        "detected_positions": F.col("true_both_finite"), "cross_tab": total(FLAGS, STATES) + F.col("missing_samples") + F.col("absent_objects"),
    })
    valid, whole = F.col("valid_positions"), F.col("missing_samples") == 0
    return out.withColumns({
        "reconciles": F.col("cross_tab") == p.slots, "position_coverage": valid / p.slots, "outside_fraction": safe_ratio("outside_pitch", "valid_positions"),
        "known_flag_coverage": F.col("known_flags") / p.slots, "detected_share": safe_ratio("flag_true", "known_flags"),
        "detection_stratum": F.when(F.col("null_both_finite") > 0, "unknown").otherwise(three_way(F.col("detected_positions"), valid, whole, "all_detected", "all_false_flag", "mixed")),
        "completeness_stratum": F.when(~whole, "unknown").when(valid == p.slots, "complete").when(valid == 0, "none").otherwise("partial"),
    })


def player_block(players: DataFrame, by: Sequence[str], expected: str = "expected_frames") -> DataFrame:
    """Counters of the players of each window: rows with x, y, is_detected, pitch_length, pitch_width, active (whether the
    roster has the player on the pitch there; null: unknown) and the window's expected player frames (null: unknown)."""
    valid = is_finite("x") & is_finite("y") & F.col("is_detected").isNotNull()
    out = players.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if(valid).alias("valid_positions"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("null_coordinates"),
        F.count_if(valid & F.col("is_detected")).alias("detected"), F.count_if(valid & ~F.col("is_detected")).alias("extrapolated"),
        F.count_if(valid & ~in_pitch("x", "y", "pitch_length", "pitch_width")).alias("outside_pitch"),
        F.count_if(valid & F.coalesce("active", F.lit(False))).alias("active_positions"), F.first(expected).alias("expected_frames"),
    )
    seen = F.col("detected") + F.col("extrapolated")
    done = safe_ratio("active_positions", "expected_frames")
    return out.withColumns({
        "completeness": done, "missing_active": F.col("expected_frames") - F.col("active_positions"), "null_fraction": safe_ratio("null_coordinates", "records"),
        "extrapolation": safe_ratio("extrapolated", seen), "outside_fraction": safe_ratio("outside_pitch", seen),
        "detection_stratum": three_way(F.col("detected"), seen, F.lit(True), "all_detected", "all_extrapolated", "mixed"),
        "completeness_stratum": F.when(done.isNull(), "unknown").when(done == 1, "complete").when(done == 0, "none").otherwise("partial"),
    })


def temporal_block(slots: DataFrame, by: Sequence[str], stride: int = 2) -> DataFrame:
    """Intervals between a window's slots (slot, present, frame, clock, period, observed, active: sorted id arrays): expected,
    observed (both ends present) and continuous ones, changes of the observed and of the active players."""
    w = Window.partitionBy(*by).orderBy("slot")

    def last(c):
        return F.lag(c).over(w)

    both = F.col("present") & F.coalesce(last("present"), F.lit(False))
    steady = both & (F.col("frame") - last("frame") == stride) & (F.col("clock") - last("clock") == stride) & (F.col("period") == last("period"))
    swapped = F.when(both, F.concat(F.array_except("active", last("active")), F.array_except(last("active"), "active")))
    rows = slots.withColumns({"__first": last("present").isNull(), "__both": both, "__steady": F.coalesce(steady, F.lit(False)), "__seen": both & (F.col("observed") != last("observed")), "__swapped": swapped})
    changed = F.col("__both") & (F.size("__swapped") > 0)
    out = rows.groupBy(*by).agg(
        F.count_if(~F.col("__first")).alias("expected_intervals"), F.count_if("__both").alias("observed_intervals"), F.count_if("__steady").alias("continuous_intervals"),
        F.count_if("__seen").alias("observed_changes"), F.count_if(changed).alias("roster_transitions"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("__swapped", F.array().cast("array<bigint>")))))).alias("changed_players"),
    )
    whole = F.col("observed_intervals") == F.col("expected_intervals")
    return out.withColumns({
        "continuity": F.when(whole, safe_ratio("continuous_intervals", "expected_intervals")), "change_fraction": safe_ratio("observed_changes", "observed_intervals"),
        "continuity_stratum": F.when(~whole, "unknown").when(F.col("continuous_intervals") == F.col("expected_intervals"), "continuous").otherwise("discontinuous"),
        "transition_stratum": F.when(~whole, "unknown").when(F.col("roster_transitions") > 0, "exposed").otherwise("none_observed"),
    })


def play_block(slots: DataFrame, by: Sequence[str], covered: str = "covered", frames: str = "frames") -> DataFrame:
    """Possession of a window's present samples by side, and the share of its source frames that phases cover (columns covered and
    frames of the window; null: unknown)."""
    side = F.when(F.col("present"), F.coalesce(F.when(F.col("possession_group").isin("home team", "away team"), F.col("possession_group")), F.lit("unknown")))
    out = slots.groupBy(*by).agg(
        F.count_if("present").alias("samples"), F.count_if(side == "home team").alias("home"), F.count_if(side == "away team").alias("away"),
        F.count_if(side == "unknown").alias("unknown"), F.first(covered).alias("covered_frames"), F.first(frames).alias("source_frames"),
    )
    share = safe_ratio("covered_frames", "source_frames")
    return out.withColumns({
        **{f"{c}_fraction": safe_ratio(c, "samples") for c in ("home", "away", "unknown")}, "phase_coverage": share,
        "play_stratum": F.when(share.isNull(), "unknown").when(share < 1, "uncovered_or_unknown").otherwise("all_in_play"),
    })


def window_quality(blocks: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """One struct column for each block, joined on the window."""
    out = None
    for name, b in blocks.items():
        one = b.select(*by, F.struct(*[c for c in b.columns if c not in by]).alias(name))
        out = one if out is None else out.join(one, list(by), "full")
    return out
