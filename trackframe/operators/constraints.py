"""Integrity constraints as queries: each returns the rows that break a rule, with a column ``problem``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite

SHA256 = r"^[0-9a-f]{64}$"


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """keys, problem: a row for each broken rule; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("problem"))


def together(*reports: DataFrame) -> DataFrame:
    """The union of several reports with one set of columns (a repository-wide roll-up)."""
    return reduce(DataFrame.unionByName, reports)


def plain_names(name: str) -> Column:
    """A feature name in the form that deny-lists are written in."""
    return F.translate(F.lower(name), "-.", "__")


def forbidden_features(names: DataFrame, name: str, denied: Sequence[str], fragments: Sequence[str]) -> DataFrame:
    """Names on the deny-list, or with a denied fragment."""
    n = plain_names(name)
    bad = n.isin(*denied)
    for f in fragments:
        bad |= n.contains(f)
    return violations(names, [name], {"forbidden_feature": bad})


def payload_fields(fields: DataFrame, payload: str, field: str, expected: Sequence[str]) -> DataFrame:
    """Payloads whose set of fields isn't exactly the expected one: payload, missing, unexpected."""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    have = fields.groupBy(payload).agg(F.collect_set(field).alias("__f"))
    out = have.select(payload, F.array_sort(F.array_except(want, "__f")).alias("missing"), F.array_sort(F.array_except("__f", want)).alias("unexpected"))
    return out.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def invalid_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics that aren't finite numbers of zero or more."""
    return violations(df, keys, {f"invalid_{m}": ~(is_finite(m) & F.coalesce(F.col(m) >= 0, F.lit(False))) for m in metrics})


def unknown_ids(scores: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids of scores that aren't among the known ones."""
    return scores.select(key).distinct().join(known.select(key), key, "left_anti").withColumn("problem", F.lit("unknown_id"))


def naming(paths: DataFrame, path: str, pattern: str, suffixes: Sequence[str]) -> DataFrame:
    """Paths that don't match the pattern, or have a forbidden suffix."""
    bad = F.lit(False)
    for s in suffixes:
        bad |= F.lower(F.col(path)).endswith(s)
    return violations(paths, [path], {"forbidden_suffix": bad, "bad_name": ~F.col(path).rlike(pattern)})


def membership(windows: DataFrame, scenes: DataFrame, match: str = "match_id", least: int = 7, history: int = 25) -> DataFrame:
    """Problems of a population's membership: match, window_id, problem.

    windows: match, ordinal (their place in the match), period, origin_index, window_id, expected_window_id.
    scenes: match, window_id, scene_ordinal, scene_id, player_ids array<long>, truth_sha256.
    Windows are ordered by period and origin without repeats; scenes are home, then away; players are unique,
    ascending and ``least`` or more; identities are the expected digests.
    """
    w = Window.partitionBy(match).orderBy("ordinal")
    before = F.lag(F.struct("period", "origin_index")).over(w)
    same = F.count("*").over(Window.partitionBy(match, "window_id"))
    rows = windows.withColumn("__before", before).withColumn("__same", same)
    of_windows = violations(rows, [match, "window_id"], {
        "order": F.struct("period", "origin_index") <= F.col("__before"),
        "history": F.col("origin_index") < history,
        "repeated": F.col("__same") > 1,
        "identity": ~F.col("window_id").eqNullSafe(F.col("expected_window_id")),
    })
    p = F.col("player_ids")
    of_scenes = violations(scenes, [match, "window_id"], {
        "too_few_players": F.coalesce(F.size(p), F.lit(0)) < least,
        "players_repeat": F.size(F.array_distinct(p)) < F.size(p),
        "players_unordered": F.array_sort(p) != p,
        "bad_digest": ~F.coalesce(F.col("truth_sha256").rlike(SHA256), F.lit(False)),
    })
    names = F.transform(F.sort_array(F.collect_list(F.struct("scene_ordinal", "scene_id"))), lambda x: x["scene_id"])
    per = scenes.groupBy(match, "window_id").agg(names.alias("__s"))
    per = windows.select(match, "window_id").distinct().join(per, [match, "window_id"], "left")
    directed = violations(per, [match, "window_id"], {"scenes": ~F.col("__s").eqNullSafe(F.array(F.lit("home"), F.lit("away")))})
    return together(of_windows, of_scenes, directed)


def exact_lookup(requests: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many rows of a table each request names: on, n, status (none, one, many)."""
    have = table.groupBy(*on).agg(F.count("*").alias("n"))
    j = requests.select(*on).distinct().join(have, list(on), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return j.withColumn("status", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many"))


def rows_per_window(rows: DataFrame, window: Sequence[str], n: int = 2) -> DataFrame:
    """Windows that don't have exactly n directed rows."""
    return rows.groupBy(*window).agg(F.count("*").alias("n")).where(F.col("n") != n)


def membership_counts(counts: DataFrame, keys: Sequence[str], windows: str, rows: str, n: int = 2) -> DataFrame:
    """Declared counts where rows are not n times the windows."""
    return violations(counts, keys, {"row_arithmetic": F.col(rows) != n * F.col(windows)})


def disjoint(assignments: DataFrame, unit: str, groupings: Sequence[str]) -> DataFrame:
    """Units that more than one group of a grouping holds: unit, grouping, n."""
    reports = [
        assignments.groupBy(unit).agg(F.count_distinct(g).alias("n")).where("n > 1").select(unit, F.lit(g).alias("grouping"), "n") for g in groupings
    ]
    return together(*reports)


def registry(entries: DataFrame, families: DataFrame, aliases: DataFrame, pattern: str = r"^[a-z0-9_]+(\.[a-z0-9_]+)*$") -> DataFrame:
    """Conflicts of a registry: id, problem. entries: id, family_id; families: family_id; aliases: alias, canonical_id."""
    fam = families.select(F.col("family_id").alias("__f")).distinct()
    e = entries.withColumn("__n", F.count("*").over(Window.partitionBy("id")))
    e = e.join(fam, e["family_id"] == F.col("__f"), "left").withColumnRenamed("__f", "__known")
    e = e.join(fam.withColumnRenamed("__f", "__is_family"), F.col("id") == F.col("__is_family"), "left")
    of_entries = violations(e, ["id"], {
        "not_canonical": ~F.col("id").rlike(pattern), "unknown_family": F.col("__known").isNull(),
        "is_family": F.col("__is_family").isNotNull(), "duplicate": F.col("__n") > 1,
    })
    ids = entries.select(F.col("id").alias("__i")).distinct()
    a = aliases.withColumn("__n", F.count("*").over(Window.partitionBy("alias")))
    a = a.join(ids, F.col("canonical_id") == F.col("__i"), "left").withColumnRenamed("__i", "__target")
    a = a.join(ids, F.col("alias") == F.col("__i"), "left").withColumnRenamed("__i", "__is_id")
    a = a.join(fam, F.col("alias") == F.col("__f"), "left")
    of_aliases = violations(a.withColumnRenamed("alias", "id"), ["id"], {
        "alias_target_missing": F.col("__target").isNull(), "alias_repeated": F.col("__n") > 1,
        "alias_is_id": F.col("__is_id").isNotNull(), "alias_is_family": F.col("__f").isNotNull(),
    })
    return together(of_entries, of_aliases)


def transitions(graph: DataFrame, consequences: dict[str, str]) -> DataFrame:
    """Problems of a transition graph: transition_id, problem. graph: transition_id, kind, consequence, explanation, evidence array;
    consequences: what each kind of transition must have."""
    want = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in consequences.items()], F.lit(None).cast("string"))
    g = graph.withColumn("__n", F.count("*").over(Window.partitionBy("transition_id")))
    return violations(g, ["transition_id"], {
        "repeated": F.col("__n") > 1, "no_evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "no_rationale": F.trim(F.coalesce("explanation", F.lit(""))) == "", "consequence": ~F.col("consequence").eqNullSafe(want),
    })


def results(records: DataFrame, scopes: dict[str, Sequence[str]], states: dict[str, str]) -> DataFrame:
    """Problems of result records: run_id, problem. records: run_id, lock_sha256, checkpoint_sha256 (null allowed), evaluator_id,
    evaluator_state, split_protocol_id, population, validity, metrics array<struct<name, value>>.
    scopes: populations of a split protocol; states: the state of an evaluator."""
    m = F.col("metrics")
    names = F.transform(m, lambda x: x["name"])
    state = F.coalesce(*[F.when(F.col("evaluator_id") == k, F.lit(v)) for k, v in states.items()], F.lit(None).cast("string"))
    allowed = F.coalesce(*[F.when(F.col("split_protocol_id") == k, F.col("population").isin(*v)) for k, v in scopes.items()], F.lit(False))
    return violations(records, ["run_id"], {
        "bad_lock": ~F.coalesce(F.col("lock_sha256").rlike(SHA256), F.lit(False)), "bad_checkpoint": ~F.col("checkpoint_sha256").rlike(SHA256),
        "metric_names": (F.size(F.array_distinct(names)) < F.size(names)) | F.exists(names, lambda n: n.isNull() | (n == "")),
        "metric_values": F.exists(m, lambda x: ~is_finite(x["value"])), "invalidated_with_metrics": (F.col("validity") == "invalidated") & (F.size(m) > 0),
        "evaluator_state": ~F.col("evaluator_state").eqNullSafe(state), "population_scope": ~F.coalesce(allowed, F.lit(False)),
    })


def result_documents(documents: DataFrame, matches: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Cross-field problems of result documents: document_id, problem. documents: document_id, population_value, n_matches, n_windows;
    matches: document_id, value (null: not scoreable), windows. A population's value is the equal mean of its matches, null if any is."""
    per = matches.groupBy("document_id").agg(
        F.count("*").alias("__n"), F.sum("windows").alias("__w"), F.count_if(F.col("value").isNull()).alias("__null"), F.avg("value").alias("__mean"),
        F.count_if(F.col("value") < 0).alias("__negative"),
    )
    j = documents.join(per, "document_id", "left")
    want = F.when(F.col("__null") == 0, F.col("__mean"))
    v = F.col("population_value")
    return violations(j, ["document_id"], {
        "match_count": ~F.col("n_matches").eqNullSafe(F.coalesce("__n", F.lit(0))), "window_count": ~F.col("n_windows").eqNullSafe(F.coalesce("__w", F.lit(0))),
        "negative_value": F.col("__negative") > 0, "population_value": F.when(v.isNull() | want.isNull(), v.isNull() != want.isNull()).otherwise(F.abs(v - want) > tolerance),
    })


def protocol_order(rows: DataFrame, ordinal: str, role: str, match: str, roles: Sequence[str]) -> DataFrame:
    """Rows whose (role, match) isn't after that of the row before: roles in their order, ids ascending in a role.

    For protocols (a few dozen matches): the order is one window."""
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role))
    w = Window.partitionBy(F.lit(0)).orderBy(ordinal)
    rows = rows.withColumn("__k", F.struct(place.alias("r"), F.col(match).alias("m")))
    rows = rows.withColumn("__last", F.lag("__k").over(w))
    return violations(rows, [ordinal, role, match], {"unknown_role": place == 0, "order": F.col("__k") <= F.col("__last")})


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a total order (a limit that is asked for)."""
    return df.orderBy(*order).limit(n)


def bounded_prefix(df: DataFrame, by: Sequence[str], order: str, expected: int) -> DataFrame:
    """Up to expected + 1 rows of each group in order: one more than expected shows that there are more."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__r", r).where(F.col("__r") <= expected + 1).drop("__r")


def resolved(references: DataFrame, sources: DataFrame, digest: str = "sha256") -> DataFrame:
    """Evidence references by digest: digest, n_references, n_matches, status (zero, one or multiple matches)."""
    r = references.groupBy(digest).agg(F.count("*").alias("n_references"))
    s = sources.groupBy(digest).agg(F.count("*").alias("n_matches"))
    j = r.join(s, digest, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long"))
    return j.withColumn("status", F.when(F.col("n_matches") == 0, "zero_matches").when(F.col("n_matches") == 1, "one_match").otherwise("multiple_matches"))


def resolution_counts(resolutions: DataFrame) -> DataFrame:
    """Counters of resolved(): one row."""
    return resolutions.agg(
        F.sum("n_references").alias("references"), F.count("*").alias("digests"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("zero_matches", "one_match", "multiple_matches")],
    )


def catalogue_matches(catalogue: DataFrame, requested: DataFrame, digest: str, status: str, good: Sequence[str], content: str | None = None) -> DataFrame:
    """Catalogue records with a requested digest and a good status; with ``content`` (binary) only those whose bytes have the digest."""
    rows = catalogue.join(requested.select(digest).distinct(), digest, "left_semi").where(F.col(status).isin(*good))
    return rows if content is None else rows.where(F.sha2(content, 256) == F.col(digest))


def reconciled(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Summaries of two independent runs: on, status (equal, different, left_only, right_only)."""
    a = left.select(*on, F.struct(*values).alias("__a"))
    b = right.select(*on, F.struct(*values).alias("__b"))
    j = a.join(b, list(on), "full")
    status = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("different")
    return j.select(*on, status.alias("status"))


def inventory_by_digest(expected: DataFrame, actual: DataFrame, digest: str, name: str) -> DataFrame:
    """Files matched by digest, one to one: digest, expected_names, actual_names, problem (null: matched)."""
    e = expected.groupBy(digest).agg(F.array_sort(F.collect_list(name)).alias("expected_names"))
    a = actual.groupBy(digest).agg(F.array_sort(F.collect_list(name)).alias("actual_names"))
    j = e.join(a, digest, "full")
    problem = (
        F.when(F.col("actual_names").isNull(), "missing").when(F.col("expected_names").isNull(), "unexpected")
        .when((F.size("expected_names") > 1) | (F.size("actual_names") > 1), "ambiguous")
    )
    return j.withColumn("problem", problem)


def ordered_pairs(left: DataFrame, right: DataFrame, ordinal: str, identity: Sequence[str]) -> DataFrame:
    """Two ordered streams row by row: ordinal, problem for rows without a partner or of another identity."""
    a = left.select(ordinal, F.struct(*identity).alias("__a"))
    b = right.select(ordinal, F.struct(*identity).alias("__b"))
    j = a.join(b, ordinal, "full")
    return violations(j, [ordinal], {
        "missing_right": F.col("__b").isNull(), "missing_left": F.col("__a").isNull(),
        "identity": F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b")),
    })


def complete_domain(rows: DataFrame, key: str, expected: Sequence) -> DataFrame:
    """One row: missing and unexpected keys, for a check that every match of a fixed list is there."""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    have = rows.agg(F.collect_set(F.when(F.col(key).isin(*expected), F.col(key))).alias("__h"), F.count_distinct(F.when(~F.col(key).isin(*expected), F.col(key))).alias("unexpected"))
    return have.select(F.array_sort(F.array_except(want, "__h")).alias("missing"), "unexpected")


def monotone(counts: DataFrame, keys: Sequence[str], chain: Sequence[str]) -> DataFrame:
    """Counts along a chain of ever narrower conditions (theoretical, complete, passing, ...) that grow."""
    rules = {f"{b}_over_{a}": F.col(b) > F.col(a) for a, b in zip(chain[:-1], chain[1:])}
    return violations(counts, keys, rules)


def preflight(files: DataFrame, name: str, digest: str, seen: str, expected: int, now: Column, most_days: int = 1) -> DataFrame:
    """One row: n_files, n_unique names, stale files (seen over most_days ago), bad digests, and whether all is well."""
    out = files.agg(
        F.count("*").alias("n_files"), F.count_distinct(name).alias("n_unique"), F.count_if(F.col(seen) < now - F.expr(f"interval {most_days} day")).alias("stale"),
        F.count_if(~F.coalesce(F.col(digest).rlike(SHA256), F.lit(False))).alias("bad_digests"),
    )
    return out.withColumn("ready", (F.col("n_unique") == expected) & (F.col("n_files") == expected) & (F.col("stale") == 0) & (F.col("bad_digests") == 0))


def run_transitions(events: DataFrame, run: str, order: str, state: str, legal: dict[str | None, Sequence[str]]) -> DataFrame:
    """Steps of runs that their state machine doesn't allow: run, order, before, state. None is the state before the first step."""
    before = F.lag(state).over(Window.partitionBy(run).orderBy(order))
    ok = F.lit(False)
    for a, b in legal.items():
        ok |= (before.isNull() if a is None else F.coalesce(before == a, F.lit(False))) & F.col(state).isin(*b)
    return events.withColumn("before", before).withColumn("__ok", ok).where("not __ok").select(run, order, "before", state)
