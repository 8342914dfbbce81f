"""From raw frames to eligible windows and truth: the whole population of a set of matches.

Inputs are DataFrames: frames (raw 10 Hz), matches (match_id, home, away, pitch_length, pitch_width),
roster (match_id, player_id, team_id, group), periods (match_id, period, start_frame, end_frame),
appearances (match_id, player_id, period, start_frame, end_frame; closed) and phases (match_id, start,
end; half-open, in-play; phase_match_id and release_id where they are known). Everything but frames is a small dimension; Spark broadcasts it below its threshold.

Slots are evaluated once per sample and pair before they are spread over windows, so the 41-fold
rows carry a code array and a few flags, not players.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import implausible, is_finite
from ..operators import eligibility as E
from ..operators import intervals, panels, samples, sequences
from ..params import DEFAULTS, Params

KEY = ["match_id", "source_frame"]


def _keyed(entries: str, key: str, value) -> Column:
    """A map of each key (as long) of an array of structs to value(its structs)."""
    held = F.filter(entries, lambda x: x[key].isNotNull())
    keys = F.array_distinct(F.transform(held, lambda x: x[key].cast("long")))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: value(F.filter(held, lambda x: x[key].cast("long") == k))))


def facts(matches: DataFrame, roster: DataFrame, periods: DataFrame, appearances: DataFrame) -> DataFrame:
    """One row a match (one for each of its rows, if matches lists it twice) with all that is stated of it: columns of matches, listed and spans (maps of a
    player's entries in the roster and appearances), active (all appearances), sides, bounds and period_codes (maps by period), roster_known."""
    codes = E.period_problems(periods).where("period is not null")
    kinds = {
        "stated": matches.select("match_id", F.struct(*[c for c in matches.columns if c != "match_id"]).alias("stated")),
        "roster": roster.select("match_id", F.struct("player_id", "team_id", "group").alias("roster")),
        "spells": periods.select("match_id", F.struct("period", "start_frame", "end_frame").alias("spells")),
        "active": appearances.select("match_id", F.struct("player_id", "period", "start_frame", "end_frame").alias("active")),
        "codes": codes.select("match_id", F.struct("period", "period_codes").alias("codes")),
    }
    rows = None
    for one in kinds.values():
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    f = rows.groupBy("match_id").agg(*[F.collect_list(k).alias(k) for k in kinds])
    f = f.withColumns({
        "listed": _keyed("roster", "player_id", lambda x: x), "spans": _keyed("active", "player_id", lambda x: x), "roster_known": E.roster_whole("roster", "active"),
        "sides": F.array_distinct(F.array_compact(F.transform("roster", lambda x: x["group"]))), "period_codes": _keyed("codes", "period", lambda x: x[0]["period_codes"]),
        "bounds": _keyed("spells", "period", lambda x: F.struct(F.array_min(x["start_frame"]).alias("start_frame"), F.array_max(x["end_frame"]).alias("end_frame"))),
    })
    # cut here, so that no task holds the sorts of these rows and those of samples
    return f.select("match_id", "listed", "spans", "active", "sides", "bounds", "period_codes", "roster_known", F.explode_outer("stated").alias("stated")).select("*", "stated.*").drop("stated").repartition("match_id")


def judged(canonical: DataFrame, matches: DataFrame, roster: DataFrame, periods: DataFrame, appearances: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Samples with what is known of their match, and players (player_id, x, y, group, disposition) of the sample (own) and of all samples of its frame (everyone).

    All that a match states is in one row, and players stay within their samples: a row a player and sample is neither shuffled nor sorted.
    A player counts once for each of their entries in the roster."""
    s = facts(matches, roster, periods, appearances)
    unlisted = F.array(F.lit(None).cast(s.schema["listed"].dataType.valueType.elementType))
    s = canonical.join(s, "match_id", "left")
    frame, period = F.col("source_frame"), F.col("period").cast("long")

    def judge(x, t):
        held = F.filter(F.col("spans")[x["player_id"].cast("long")], lambda a: a["period"] == F.col("period"))
        inside = F.exists(held, lambda a: (frame >= a["start_frame"]) & (frame <= a["end_frame"]))
        of = {
            "n_same": F.lit(1), "team_ok": t["team_id"].isNotNull() & (t["team_id"].eqNullSafe(F.col("home")) | t["team_id"].eqNullSafe(F.col("away"))),
            "is_detected": x["is_detected"], "x": x["x_m"], "y": x["y_m"], "in_appearance": F.when(F.size(held) > 0, inside),
        }
        verdict = E.player_disposition(p, lambda c: of[c] if c in of else F.col(c))
        return F.struct(x["player_id"].alias("player_id"), x["x_m"].alias("x"), x["y_m"].alias("y"), t["group"].alias("group"), verdict.alias("disposition"))

    own = F.flatten(F.transform("players", lambda x: F.transform(F.coalesce(F.col("listed")[x["player_id"].cast("long")], unlisted), lambda t: judge(x, t))))
    seen = F.coalesce(F.transform("players", lambda x: x["player_id"]), F.array().cast("array<bigint>"))
    absent = F.exists("active", lambda t: (t["period"] == F.col("period")) & (frame >= t["start_frame"]) & (frame <= t["end_frame"]) & ~F.array_contains(seen, t["player_id"]))
    s = s.withColumns({
        "own": own, "absent": absent, "start_frame": F.col("bounds")[period]["start_frame"], "end_frame": F.col("bounds")[period]["end_frame"], "period_codes": F.col("period_codes")[period],
    }).drop("players", "listed", "spans", "bounds", "active", "home", "away")
    s = s.withColumn("everyone", F.flatten(F.collect_list("own").over(Window.partitionBy(*KEY))))
    s = s.withColumn("__ids", F.transform("everyone", lambda x: x["player_id"]))

    def once(players: str):
        """Players of whom a frame has several are duplicates, whatever else they are."""
        n = lambda x: F.size(F.filter("__ids", lambda i: i.eqNullSafe(x["player_id"])))
        told = F.transform(players, lambda x: x.withField("disposition", F.when(n(x) > 1, "DUPLICATE_PLAYER_ID").otherwise(x["disposition"])))
        return F.when(F.size(F.array_distinct("__ids")) == F.size("__ids"), F.col(players)).otherwise(told)

    return s.withColumns({"own": once("own"), "everyone": once("everyone")}).drop("__ids")


def sample_rules(samples: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row a sample of judged() with its codes and warnings and the state of its ball."""
    counted = F.filter("everyone", lambda x: x["disposition"].isin(*E.COUNTED))
    some = F.size("everyone") > 0  # nothing is known of a sample without players
    s = samples.withColumns({
        "spots": F.when(some, F.transform(counted, lambda x: F.struct(x["player_id"].alias("player_id"), x["x"].alias("x"), x["y"].alias("y")))),
        "__sides": F.transform(counted, lambda x: x["group"]),
        "player_codes": F.array_distinct(F.transform(F.filter("everyone", lambda x: x["disposition"] != "valid"), lambda x: x["disposition"])),
    })
    full = F.forall("sides", lambda g: F.size(F.filter("__sides", lambda x: x == g)) >= p.min_players)
    s = s.withColumns({"observed": F.array_distinct(F.array_compact(F.transform("spots", lambda x: x["player_id"]))), "team_ok_min": F.when(F.size("sides") > 0, full)})
    roster_known = F.coalesce("roster_known", F.lit(False))
    s = s.withColumns({
        "present": F.lit(True), "frame": F.col("source_frame"), "idx": F.col("canonical_sample_index"), "clock": F.col("timestamp_deciseconds"),
        "ball_present": F.col("ball").isNotNull(), "ball_x": F.col("ball.x_m"), "ball_y": F.col("ball.y_m"), "ball_flag": F.col("ball.is_detected"),
        "possession_group": F.col("possession.group"), "possession_player": F.col("possession.player_id"),
        "possession_observed": F.array_contains(F.coalesce("observed", F.array().cast("array<bigint>")), F.col("possession.player_id")),
    })
    s = E.slot_warnings(E.slot_codes(s))
    finite = is_finite("ball_x") & is_finite("ball_y")
    far = implausible("ball_x", "ball_y", "pitch_length", "pitch_width", p.ball_factor)
    own = E.codes(
        COORDINATE_IMPLAUSIBLE=finite & far,
        NONFINITE_COORDINATE=F.col("ball_x").isNotNull() & ~is_finite("ball_x") | F.col("ball_y").isNotNull() & ~is_finite("ball_y"),
        PLAYER_COUNT_BELOW_TEAM_MINIMUM=~F.coalesce("team_ok_min", F.lit(False)),
        INVALID_MATCH_METADATA=~F.coalesce("metadata_ok", F.lit(False)),
        PLAYER_APPEARANCE_METADATA_UNKNOWN=~roster_known,
        PLAYER_OBSERVATION_MISSING=roster_known & F.col("absent"),
    )
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat("slot_codes", "slot_warnings", own, F.coalesce("player_codes", none), F.coalesce("period_codes", none), F.array(F.lit("SOURCE_QUALITY_UNKNOWN"))))
    return s.select(*KEY, *[c for c in s.columns if c == "ordinal"], "period", "idx", "clock", "observed", "spots", every.alias("sample_codes"), (finite & ~far if p.version == 1 else finite).alias("ball_ok"), "ball_x", "ball_y")


def pair_rules(rules: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds pair_codes: what is wrong between a sample and the one before it in the match, in the order of the source (the
    column ordinal; where frames have none, in the order of their numbers, which can't show disorder)."""
    w = Window.partitionBy("match_id").orderBy("ordinal" if "ordinal" in rules.columns else "source_frame")

    def d(c):
        return F.col(c) - F.lag(c).over(w)

    first = F.lag("source_frame").over(w).isNull()
    crossed = ~first & (F.col("period") != F.lag("period").over(w))
    near = ~first & ~F.coalesce(crossed, F.lit(False))
    ball = F.hypot(d("ball_x"), d("ball_y")) / 0.2
    step = near & (d("idx") == 1) & (d("source_frame") == p.stride) & (d("clock") == p.stride)
    was = F.map_from_entries(F.transform(F.lag("spots").over(w), lambda t: F.struct(t["player_id"], t)))
    rules = rules.withColumn("was", was)
    moved = F.exists("spots", lambda t: F.hypot(t["x"] - F.col("was")[t["player_id"]]["x"], t["y"] - F.col("was")[t["player_id"]]["y"]) / 0.2 > p.player_speed)
    return rules.withColumn(
        "pair_codes",
        E.codes(
            PERIOD_BOUNDARY_CROSSED=crossed,
            TEMPORAL_GAP=near & ((d("idx") > 1) | (d("source_frame") > p.stride)),
            DUPLICATE_SAMPLE=near & ((d("idx") == 0) | (d("source_frame") == 0)),
            NONMONOTONIC_SAMPLE_ORDER=near & ((d("idx") < 0) | (d("source_frame") < 0)),
            TIMESTAMP_DISCONTINUITY=near & (d("clock") != p.stride),
            IDENTITY_TRANSITION_EXPOSURE=near & (F.array_sort("observed") != F.lag(F.array_sort("observed")).over(w)),
            PLAYER_DISPLACEMENT_OUTLIER=step & moved,
            BALL_DISPLACEMENT_OUTLIER=near & (d("source_frame") == p.stride) & (ball > p.ball_speed),
        ),
    )


def windows(rules: DataFrame, periods: DataFrame, phases: DataFrame, p: Params = DEFAULTS, release: str | None = None, support: DataFrame | None = None) -> DataFrame:
    """match_id, period, origin_frame, exclusion_reasons, warnings, eligible of every grid origin.

    support (match_id, origin_frame, n_support): where a caller's windows state how many slots they have, those of another number than
    the parameters' are excluded; the grid's own windows always have the whole number, absent samples being gaps.

    A phase with a problem covers nothing, and its codes exclude all windows of its match. Phases without
    phase_match_id are of match_id; their release is compared if one is given."""
    if "phase_match_id" not in phases.columns:
        phases = phases.withColumn("phase_match_id", F.col("match_id"))
    if release is None or "release_id" not in phases.columns:
        phases = phases.withColumn("release_id", F.lit(None).cast("string"))
    phases = E.phase_problems(phases, release)
    phase_codes = phases.groupBy("match_id").agg(F.array_distinct(F.flatten(F.collect_set("phase_codes"))).alias("phase_codes"))
    phases = phases.where(F.size("phase_codes") == 0).select("match_id", "start", "end")
    by = ["match_id", "origin_frame"]
    grid = sequences.even_grid(periods.select("match_id", "period", "start_frame", "end_frame")).select("match_id", "period", "origin_frame")
    s = pair_rules(rules, p).select("match_id", "source_frame", "sample_codes", "pair_codes", "ball_ok").withColumnRenamed("source_frame", "frame")
    s = sequences.slots(grid, s, ["match_id"], "origin_frame", "frame", p.history, p.future, p.stride)
    # a window's first slot has no pair
    gap = F.when(~F.col("present"), F.array(F.lit("TEMPORAL_GAP"))).otherwise(F.when(F.col("slot") > -p.history, F.col("pair_codes")).otherwise(F.array().cast("array<string>")))
    s = s.withColumn("gap_codes", gap)
    out = E.judged(s, by, ["sample_codes", "gap_codes"], p).join(grid, by)
    spans = grid.select("match_id", (F.col("origin_frame") - p.history * p.stride).alias("a"), (F.col("origin_frame") + p.future * p.stride).alias("b"))
    bare = intervals.first_uncovered(spans, intervals.merge(phases, ["match_id"]), ["match_id"], "a", "b")
    bare = bare.select("match_id", (F.col("a") + p.history * p.stride).alias("origin_frame"), "first_uncovered")
    out = out.join(bare, by, "left").join(phase_codes, "match_id", "left")
    last = {"PHASE_NOT_IN_PLAY_OR_UNKNOWN": F.col("first_uncovered").isNotNull()}
    if support is not None:
        out = out.join(support.select(*by, "n_support"), by, "left")
        last |= E.support_length(F.coalesce("n_support", F.lit(p.slots)), p)
    phase = E.codes(**last)
    out = out.withColumn("exclusion_reasons", F.array_sort(F.array_distinct(F.concat("exclusion_reasons", phase, F.coalesce("phase_codes", F.array().cast("array<string>"))))))
    return out.select("match_id", "period", "origin_frame", "exclusion_reasons", "warnings", (F.size("exclusion_reasons") == 0).alias("eligible"), "ball_fraction")


def produce(frames: DataFrame, matches: DataFrame, roster: DataFrame, periods: DataFrame, appearances: DataFrame, phases: DataFrame, p: Params = DEFAULTS, release: str | None = None, support: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, truth panels of the eligible ones): see windows() and panels.truth_panel()."""
    canonical = samples.canonical(frames, p.version)
    dims = E.metadata_problems(matches)
    rows = judged(canonical, dims, roster, periods, appearances, p)
    found = windows(sample_rules(rows, p), periods, phases, p, release, support)
    good = found.where("eligible").select("match_id", "origin_frame")
    counted = rows.select("match_id", F.col("source_frame").alias("frame"), F.explode("own").alias("x")).where(F.col("x.disposition").isin(*E.COUNTED))
    counted = counted.select("match_id", "x.player_id", "x.group", "frame", "x.x", "x.y")
    origin = counted.withColumnRenamed("frame", "origin_frame").join(good, ["match_id", "origin_frame"])
    panel = panels.truth_panel(origin, counted, ["match_id"], p.future, p.stride)
    return found, panel


