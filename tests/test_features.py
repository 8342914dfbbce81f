"""Scene features and networks against a plain NumPy form; truth panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import features

HISTORY, FUTURE = range(-25, 1), range(1, 16)


def network(r, sizes):
    return [(r.normal(0, 0.2, (a, b)), r.normal(0, 0.1, b)) for a, b in zip(sizes[:-1], sizes[1:])]


def rows(r):
    """Two windows, teams of 8 and 9, slots missing now and then, one player only seen later."""
    out, ball = {}, {}
    for w in (1, 2):
        for side, ids in (("home", range(1, 9)), ("away", range(11, 20))):
            for i in ids:
                for s in range(-25, 16):
                    if r.random() < 0.2 or i == 19 and s <= 0:
                        continue
                    out[w, side, i, s] = (None, None) if r.random() < 0.1 else (float(r.normal()), float(r.normal()))
        for s in range(-25, 16):
            ball[w, s] = (float(r.normal()), None if r.random() < 0.1 else float(r.normal()))
    return out, ball


def triples(get, slots):
    out = []
    for s in slots:
        v = get(s)
        out += [0.0, 0.0, 0.0] if v is None or None in v else [*v, 1.0]
    return np.array(out)


def plain(out, ball, w, side, i, regime, enc, fut):
    def code(side_, net, slots):
        ids = sorted({k[2] for k in out if k[0] == w and k[1] == side_})
        own = [j for j in ids if any((w, side_, j, s) in out for s in slots)]
        c = [features.layers(triples(lambda s: out.get((w, side_, j, s)), slots)[None], net, True)[0] for j in own]
        return np.sum(c, axis=0) / max(len(c), 1) if c else np.zeros(16)

    other = "away" if side == "home" else "home"
    parts = [triples(lambda s: out.get((w, side, i, s)), HISTORY), code(side, enc, HISTORY), code(other, enc, HISTORY), triples(lambda s: ball.get((w, s)), HISTORY), 0.2 * np.arange(-25, 1), [1.0 if side == "home" else -1.0]]
    if regime != "history_only":
        parts.append(triples(lambda s: ball.get((w, s)), FUTURE))
    if regime == "future_opponent_plus_ball":
        parts.append(code(other, fut, FUTURE))
    return np.concatenate(parts)


@pytest.mark.parametrize("regime", list(features.WIDTHS))
def test_scene_features_and_predictions(spark, regime):
    r = np.random.default_rng(1)
    out, ball = rows(r)
    enc, fut = network(r, (78, 32, 16)), network(r, (45, 32, 16))
    players = spark.createDataFrame([(*k, *v) for k, v in out.items()], "window_id long, side string, player_id long, slot int, x double, y double")
    b = spark.createDataFrame([(*k, *v) for k, v in ball.items()], "window_id long, slot int, x double, y double")
    targets = players.select("window_id", "side", "player_id").distinct()
    made = features.scene_features(players, b, targets, regime, features.encoder(spark, enc), features.encoder(spark, fut))
    heads = {c: network(r, (features.WIDTHS[regime], 32, 30)) for c in ("a", "b")}
    got = features.predicted(made.repartition(3), heads, ["window_id", "side", "player_id"]).collect()
    vectors = {(x.window_id, x.side, x.player_id): np.array(x.features) for x in made.collect()}
    assert len(vectors) == 2 * 17 and len(got) == 2 * len(vectors)
    for k, v in vectors.items():
        assert len(v) == features.WIDTHS[regime]
        assert np.allclose(v, plain(out, ball, *k, regime, enc, fut), atol=1e-9)
    for x in got:
        want = features.layers(vectors[x.window_id, x.side, x.player_id][None], heads[x.cell], False)[0]
        assert np.allclose(x.prediction, want, atol=1e-9)


def test_truth_problems(spark):
    good = [(s, p, t, 1.0 + t, 2.0, float(t), 0.0, 1.0, 2.0, True) for s in range(5) for p in (1, 2) for t in (1, 2, 3)]
    df = spark.createDataFrame(good, "scene int, player_id int, step int, x double, y double, dx double, dy double, x0 double, y0 double, mask boolean")
    at = lambda s: (F.col("scene") == s) & (F.col("step") == 2)
    df = df.withColumn("x", F.when(at(1), None).otherwise(F.col("x"))).withColumn("dx", F.when(at(2), 7.0).when(at(3), float("nan")).otherwise(F.col("dx")))
    df = df.where(~at(4))
    got = {(r.scene, r.problem) for r in features.truth_problems(df, ["scene"], 2, 3).collect()}
    assert got == {(1, "mask"), (2, "representations"), (3, "not_finite"), (3, "representations"), (4, "shape")}
