"""Exact order statistics and resampled means without a buffer a group.

Percentiles are selected by counts: a pass counts a group's values in equal bins between its smallest and largest value, the bin that
holds a wanted rank becomes the next range, and so on until a range has few values or one; only those are sorted. A task returns
at most a row for each bin of each open range, whatever a group's share of all rows is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Bins of a range in a pass, and values that are sorted in one place.
BINS, FEW = 4096, 65536


def percentiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, q, value: exact percentiles of each group, linear between neighbours. Nulls and NaNs count for nothing; a group without another value has no row.

    With no column in ``by`` all rows are one group."""
    keys = [f"__k{i}" for i in range(len(by))] or ["__k0"]
    groups = [F.col(b) for b in by] or [F.lit(0)]
    rows = df.select(*[g.alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    # an infinite value would make a range without bins
    finite = F.abs("__v") < F.lit(float("inf"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if(~finite & (F.col("__v") < 0)).alias("__low"), F.count_if(~finite & (F.col("__v") > 0)).alias("__high"), F.min(F.when(finite, F.col("__v"))).alias("lo"), F.max(F.when(finite, F.col("__v"))).alias("hi"))
    sizes = staged(sizes, "sizes")
    place = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("__at", F.col("q") * (F.col("__n") - 1))
    place = place.withColumns({"__down": F.floor("__at"), "__up": F.ceil("__at")})
    want = place.select(*keys, "__n", "__low", "__high", "lo", "hi", F.explode(F.array("__down", "__up")).alias("rank")).distinct()
    infinite = F.when(F.col("rank") < F.col("__low"), float("-inf")).when(F.col("rank") >= F.col("__n") - F.col("__high"), float("inf"))
    want = want.withColumn("found", F.coalesce(infinite, F.when(F.col("lo") == F.col("hi"), F.col("lo"))))
    # a range: values from lo to hi, ``before`` of the group's values below it and ``count`` in it
    state = want.select(*keys, "rank", "lo", "hi", F.col("__low").alias("before"), (F.col("__n") - F.col("__low") - F.col("__high")).alias("count"), "found")
    values = rows.where(finite)
    done = state.where("found is not null").select(*keys, "rank", "found")
    state = staged(state.where("found is null"), "ranges")
    ready = state.where(F.col("count") <= few)
    state = state.where(F.col("count") > few)
    while not state.isEmpty():
        ranges = state.select(*keys, "lo", "hi", "before").distinct()
        inside = values.join(ranges, same(values, ranges))
        inside = inside.where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the range itself may overflow
        bin_ = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
        k = [values[x] for x in keys]
        counted = inside.groupBy(*k, "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        counted = staged(counted, "bins")
        w = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins rows at most
        counted = counted.withColumn("below", F.coalesce(F.sum("count").over(w), F.lit(0)))
        s, c = state.drop("count", "found"), counted.withColumnsRenamed({"lo": "clo", "hi": "chi"})
        on = [*same(s, c), F.col("lo") == F.col("clo"), F.col("hi") == F.col("chi")]
        on += [F.col("rank") - F.col("before") >= F.col("below"), F.col("rank") - F.col("before") < F.col("below") + F.col("count")]
        new = s.join(c, on).select(*[s[x] for x in keys], "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("below")).alias("before"), "count", F.when(F.col("low") == F.col("high"), F.col("low")).alias("found"))
        new = staged(new, "ranges")
        done = done.unionByName(new.where("found is not null").select(*keys, "rank", "found"))
        ready = ready.unionByName(new.where(F.col("found").isNull() & (F.col("count") <= few)))
        state = new.where(F.col("found").isNull() & (F.col("count") > few))
    small = ready.select(*keys, "lo", "hi", "before").distinct()
    held = values.join(small, same(values, small)).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
    held = held.groupBy(*[values[x] for x in keys], "lo", "hi", "before").agg(F.sort_array(F.collect_list("__v")).alias("vs"))  # few at most
    r, h = ready.drop("count", "found"), held.withColumnsRenamed({"lo": "clo", "hi": "chi", "before": "b"})
    picked = r.join(h, [*same(r, h), F.col("lo") == F.col("clo"), F.col("hi") == F.col("chi"), F.col("before") == F.col("b")])
    picked = picked.select(*[r[x] for x in keys], "rank", F.element_at("vs", (F.col("rank") - F.col("before") + 1).cast("int")).alias("found"))
    found = staged(done.unionByName(picked), "found")
    a, b = (found.select(*[F.col(x).alias(x + s) for x in keys], F.col("rank").alias("rank" + s), F.col("found").alias("v" + s)) for s in ("_a", "_b"))
    j = place.join(a, [*[place[x].eqNullSafe(a[x + "_a"]) for x in keys], F.col("__down") == F.col("rank_a")])
    j = j.join(b, [*[place[x].eqNullSafe(b[x + "_b"]) for x in keys], F.col("__up") == F.col("rank_b")])
    up = F.col("__at") - F.col("__down")
    between = F.when(F.col("v_a") == F.col("v_b"), F.col("v_a")).otherwise((1 - up) * F.col("v_a") + up * F.col("v_b"))
    return j.select(*[F.col(k).alias(b_) for k, b_ in zip(keys, by)], "q", between.alias("value"))


#: A prime; products of two numbers below it fit 64 bits.
_PRIME = (1 << 31) - 1
#: Multipliers and increments of the counter hash (fixed values: a query's SQL states them too).
_A, _B, _C, _D = 48271, 69621, 40692, 16807


def counter_hash(row: str, replicate: str) -> str:
    """SQL of a number below the prime for a row's whole number and a replicate's, the same in every engine with 64-bit numbers."""
    mod = f"({row} % {_PRIME} + {_PRIME}) % {_PRIME}"
    x = f"(({mod}) * {_A} + {replicate} * {_B} + 12345) % {_PRIME}"
    x = f"(({x}) * (({x}) % 65536 + {_D}) + {_C} * {replicate}) % {_PRIME}"
    return f"(({x}) * {_D} + {_C}) % {_PRIME}"


def poisson_weight(x: str, most: int = 9) -> str:
    """SQL of a Poisson(1) weight for a number below the prime: how many of the distribution's steps it reaches."""
    total, steps = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"CASE WHEN {x} >= {int(total * _PRIME)} THEN 1 ELSE 0 END")
    return "(" + " + ".join(steps) + ")"


def bootstrap(df: DataFrame, by: Sequence[str], row: str, value: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """by, mean, low, high, n: the percentile interval of each group's mean under resampling with Poisson weights, in one pass for all replicates.

    A row's weight in a replicate is a hash of its number ``row`` and the replicate's, so the result depends on the rows alone; tasks add up
    weights and weighted values of all replicates before anything is shuffled (resamples rows a group and task). Null values count for nothing."""
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(row).cast("long").alias("__row"), F.col(value).cast("double").alias("__v"))
    each = v.withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    each = each.withColumn("__x", F.expr(counter_hash("__row", "__r"))).withColumn("__w", F.expr(poisson_weight("__x")))
    means = each.groupBy(*by, "__r").agg((F.sum(F.col("__w") * F.col("__v")) / F.nullif(F.sum("__w"), F.lit(0))).alias("__m"))
    half = (1 - level) / 2
    bounds = means.groupBy(*by).agg(F.percentile("__m", half).alias("low"), F.percentile("__m", 1 - half).alias("high"))  # resamples values a group
    plain = v.groupBy(*by).agg(F.avg("__v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return plain.join(bounds, list(by)).select(*by, "mean", "low", "high", "n")
