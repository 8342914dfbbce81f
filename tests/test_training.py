"""Training against one process, and the directory source against a plain walk."""

import hashlib
import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import sequences, training
from trackframe.sources import tree


def rows(seed=1, matches=3):
    r = np.random.default_rng(seed)
    true = np.random.default_rng(0).normal(size=(4, 4))
    out = []
    for m in range(matches):
        for w in range(r.integers(2, 5)):
            for s in ("home", "away"):
                for _ in range(r.integers(1, 4)):
                    x = r.normal(size=4)
                    y = [float(v) for v in x @ true + r.normal(size=4) * 0.05]
                    if r.random() < 0.2:
                        y[r.integers(0, 4)] = None
                    out.append((m, w, s, x.tolist(), y))
    return out + [(0, 99, "home", [0.0] * 4, [None] * 4)]  # a scene without truth


SCHEMA = "m int, w int, s string, f array<double>, t array<double>"


def test_gradient_is_that_of_differences():
    head = training.Head([4, 5, 4])
    p, r = head.start(3), np.random.default_rng(2)
    x, y, w = r.normal(size=(6, 4)), r.normal(size=(6, 4)), r.random(6)
    y[2, 1] = np.nan
    loss, g = head.loss(p, x, y, w)
    for i in range(0, len(p), 3):
        step = np.zeros_like(p)
        step[i] = 1e-6
        assert g[i] == pytest.approx((head.loss(p + step, x, y, w)[0] - head.loss(p - step, x, y, w)[0]) / 2e-6, rel=1e-5, abs=1e-7)


def test_training_is_that_of_one_process(spark, monkeypatch):
    monkeypatch.setattr(training, "TOGETHER", 4)
    data = training.prepared(spark.createDataFrame(rows(), SCHEMA).repartition(3), "m", "w", "s", "f", "t")
    valid = training.prepared(spark.createDataFrame(rows(7), SCHEMA), "m", "w", "s", "f", "t")
    taken = []
    own = training.drawn
    monkeypatch.setattr(training, "drawn", lambda *a: taken.append(own(*a)) or taken[-1])
    head = training.Head([4, 6, 4])
    p, history = training.train(data, valid, head, batch=8, steps=10, every=2, patience=2, seed=5, optimiser=training.AdamW(rate=0.05, decay=0.01))
    # the same by hand, over the same draws
    scenes = {}
    for m, w, s, *_, y in rows(7):
        scenes.setdefault((m, w, s), []).append(sum(y[i] is not None and y[i + 1] is not None for i in (0, 2)))
    scenes = {k: sum(v) for k, v in scenes.items() if sum(v)}
    v = [(x, y, 1 / scenes[m, w, s] / len(scenes)) for m, w, s, x, y in rows(7) if (m, w, s) in scenes]
    nan = lambda y: [np.nan if c is None else c for c in y]
    vx, vy, vw = np.array([a for a, *_ in v]), np.array([nan(b) for _, b, _ in v]), np.array([c for *_, c in v])
    q, first, second, best, kept, since, seen = head.start(5), 0, 0, np.inf, None, 0, []
    every = [r for d in taken for r in d.collect()]
    for step in range(1, history[-1][0] + 1):
        b = [r for r in every if r.step == step]
        assert sum(r.weight * sum(not np.isnan(r.y[i]) and not np.isnan(r.y[i + 1]) for i in (0, 2)) for r in b) == pytest.approx(1)  # each draw has weight 1 / batch
        loss, g = head.loss(q, np.array([r.x for r in b]), np.array([r.y for r in b]), np.array([r.weight for r in b]))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        q = q - 0.05 * 0.01 * q - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step % 2 == 0:
            now = head.loss(q, vx, vy, vw)[0]
            seen.append((step, loss, now, now < best))
            best, kept = (now, q) if now < best else (best, kept)
    assert np.allclose(p, kept, atol=1e-8) and [h[0] for h in history] == [s[0] for s in seen] and [h[3] for h in history] == [s[3] for s in seen]
    assert np.allclose([h[1:3] for h in history], [s[1:3] for s in seen], atol=1e-8)
    # the loop stops where early_stop says so
    h = spark.createDataFrame([(1, a, float(c)) for a, _, c, _ in history], "k int, step int, score double")
    stops = [r.step for r in sequences.early_stop(h, ["k"], "step", "score", 2).where("stop").collect()]
    assert not stops or stops == [history[-1][0]]


def test_tree_is_a_plain_walk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"hello")
    (tmp_path / "a" / "none").write_bytes(b"")
    (tmp_path / "a" / "b" / unicodedata.normalize("NFD", "é")).write_bytes(b"1" * 3_000_000)
    (tmp_path / "a" / "b" / unicodedata.normalize("NFC", "é")).write_bytes(b"2")
    os.symlink("x", tmp_path / "a" / "link")
    os.symlink("../a", tmp_path / "a" / "loop")
    os.symlink("nowhere", tmp_path / "broken")
    want = []
    for at, folders, files in os.walk(os.fsencode(tmp_path)):
        for n in folders + files:
            full = os.path.join(at, n)
            path = os.path.relpath(full, os.fsencode(tmp_path))
            if os.path.islink(full):
                row = ("link", len(os.readlink(full)), hashlib.sha256(os.readlink(full)).hexdigest())
            elif os.path.isdir(full):
                row = ("folder", None, None)
            else:
                raw = open(full, "rb").read()
                row = ("file", len(raw), hashlib.sha256(raw).hexdigest())
            want.append((unicodedata.normalize("NFC", path.decode()), path, *row))
    spark.dataSource.register(tree.TreeSource)
    for n in (1, 2, 3, 50):
        got = [(r.path, bytes(r.raw), r.kind, r.size, r.sha256) for r in spark.read.format("tree").option("partitions", n).load(str(tmp_path)).collect()]
        assert sorted(got, key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])
    twice = spark.read.format("tree").load(str(tmp_path)).groupBy("path").agg(F.count("*").alias("n")).where("n > 1").collect()
    assert [r.path for r in twice] == ["a/b/é"]
