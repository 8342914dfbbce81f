"""Exact percentiles by counts and hashed bootstrap weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import ranks, stats

QS = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]


@pytest.mark.parametrize("bins, few", [(2, 1), (7, 10), (4096, 65536)])
def test_percentiles_are_those_of_a_sort(spark, bins, few):
    r = random.Random(bins)
    kinds = {
        "a": [r.gauss(0, 1) for _ in range(80)], "ties": [float(r.randint(0, 3)) for _ in range(60)], "one": [4.5], "same": [2.0] * 30,
        "wide": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(50)], "ends": [float("-inf")] * 3 + [float("inf")] * 4 + [1.0, 2.0, 5.0], None: [1.0, 2.0, 3.0, 4.0],
    }
    rows = [(k, x) for k, v in kinds.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {(x.k, x.q): x.value for x in ranks.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", QS, bins, few).collect()}
    assert {k for k, _ in got} == set(kinds)
    for k, v in kinds.items():
        with np.errstate(invalid="ignore"):
            want = np.percentile(v, [100 * q for q in QS])
        for q, w in zip(QS, want):
            s, at = sorted(v), q * (len(v) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert low <= got[k, q] <= high and (low == high or np.isinf(low) or np.isinf(high) or got[k, q] == pytest.approx(w, rel=1e-9))


def test_all_rows_as_one_group(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    got = {x.q: x.value for x in ranks.percentiles(df, [], "v", [0.25, 0.5], bins=16, few=50).collect()}
    assert got == dict(zip([0.25, 0.5], np.percentile(np.array([r.v for r in df.collect()]), [25, 50])))
    assert ranks.percentiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_weights_are_poisson(spark):
    x = spark.range(2000).select(F.col("id").alias("row")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(49))))
    x = x.withColumn("x", F.expr(ranks.counter_hash("row", "r"))).withColumn("w", F.expr(ranks.poisson_weight("x")))
    whole = x.agg(F.avg("w"), F.var_pop("w"), F.count_if(F.col("w") == 0) / F.count("*")).first()
    assert np.allclose(list(whole), [1, 1, np.exp(-1)], atol=0.02)
    for other in (1, 7):  # neighbours in a replicate, and a row in two replicates
        a = x.select("row", "r", "w")
        b = a.select((F.col("row") + other).alias("row"), "r", F.col("w").alias("v"))
        assert abs(a.join(b, ["row", "r"]).agg(F.corr("w", "v")).first()[0]) < 0.02
        c = a.select("row", (F.col("r") + other).alias("r"), F.col("w").alias("v"))
        assert abs(a.join(c, ["row", "r"]).agg(F.corr("w", "v")).first()[0]) < 0.02


def test_interval_agrees_with_resampling(spark):
    r = np.random.default_rng(5)
    rows = [(k, i, float(x)) for k, n in (("a", 400), ("b", 150)) for i, x in enumerate(r.gamma(2.0, 3.0, n))] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = {x.k: x for x in ranks.bootstrap(df, ["k"], "id", "v", 1000).collect()}
    other = {x.k: x for x in stats.bootstrap_mean(df, ["k"], "v", 1000).collect()}
    for k, x in got.items():
        width = other[k].high - other[k].low
        assert x.mean == pytest.approx(other[k].mean) and x.n == {"a": 400, "b": 150}[k]
        assert abs(x.low - other[k].low) < 0.12 * width and abs(x.high - other[k].high) < 0.12 * width
    again = {x.k: x for x in ranks.bootstrap(df.repartition(7), ["k"], "id", "v", 1000).collect()}
    assert all(np.allclose([got[k].low, got[k].high], [again[k].low, again[k].high], rtol=1e-12) for k in got)
