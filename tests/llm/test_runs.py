"""Periodic runs against brute force, and on long texts."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.llm import runs

from .test_dedup import WORD, frame


def brute(ws, least=24, times=3):
    """Maximal stretches of each period; the smallest period of a stretch counts."""
    n, found = len(ws), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, m, q) for (i, m), q in found.items())


def expected(doc_id, text, plant=True):
    ws = WORD.findall(text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
    own = brute(ws)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2])) if own else (None,) * 3
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in own)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, n, len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), own, kept


def words_of(r):
    out = []
    for _ in range(r.randint(0, 6)):
        base = [r.choice("abcé") * r.randint(1, 2) for _ in range(r.randint(1, 9))]
        out += base * r.randint(1, 9) + base[: r.randint(0, len(base))]
    return out


def rows_of(seed=5):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "x " * 500), (6, "a b " * 11 + "a b"), (7, "a b " * 12)]
    rows += [(8 + i, r.choice([" ", "\n", " \t"]).join(words_of(r))) for i in range(120)]
    rows += [(200 + i, " ".join(str(r.randint(0, 10**6)) for _ in range(40))) for i in range(60)]  # only what is planted repeats
    return rows + [rows[40], rows[40], (None, "y z " * 20), (None, None)]


def test_runs_are_those_of_brute_force(spark):
    rows = rows_of()
    docs = frame(spark, rows).withColumn("start", F.lit("clash")).withColumn("runs", F.lit(1)).repartition(3)
    got = runs.periodic_runs(docs, plant=runs.planted).collect()
    assert sorted(map(str, ((*x[:9],) for x in got))) == sorted(str(expected(*x)[0]) for x in rows)
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    for i, t in rows:
        if i is not None:
            _, own, kept = expected(i, t)
            assert [tuple(x) for x in by[i].runs] == own and by[i].collapsed == kept
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[-64:-4])


def test_query_returns_its_columns(spark, sf):
    got = runs.op11_periodic_runs(spark, sf)
    assert {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"} <= set(got.columns)
    assert "long" in dict(got.select(F.col("n_runs").cast("string")).dtypes) or dict(got.dtypes)["n_runs"] == "bigint"


def test_runs_of_an_empty_table(spark):
    assert runs.periodic_runs(frame(spark, rows_of()).limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(frame(spark, rows_of()), times=2)


@pytest.mark.parametrize("jumps", [0, 2, 16])
def test_next_smaller(monkeypatch, jumps):
    monkeypatch.setattr(runs, "JUMPS", jumps)
    r = random.Random(2)
    for k in range(60):
        x = np.array([0] * (k % 2) + list(range(k, 0, -1)) + [r.randint(0, 40) for _ in range(r.randint(1, 120))], dtype=np.int32)
        assert runs.next_smaller(x).tolist() == [next((j for j in range(i + 1, len(x)) if x[j] < x[i]), len(x)) for i in range(len(x))]


@pytest.mark.parametrize("least", [3, 7, 24])
def test_runs_inside_of_many_texts(least):
    r = random.Random(least)
    for _ in range(60):
        docs = [[r.randint(1, 2) for _ in range(r.randint(0, 40))] + [1, 2, 3] * r.randint(0, 9) for _ in range(r.randint(1, 5))]
        ids = np.array([x for d in docs for x in d + [0]], dtype=np.int32)
        start = np.cumsum([0] + [len(d) + 1 for d in docs])[:-1]
        at, length, period = runs.runs_of(ids, start, least)
        owner = np.searchsorted(start, at, side="right") - 1
        for d, ws in enumerate(docs):
            mine = owner == d
            assert list(zip(at[mine] - start[d], length[mine], period[mine])) == brute(ws, least)


@pytest.mark.parametrize("text", [b"word " * 2_000_000, b" ".join(b"%d" % (i * 7919 % 1_000_003) for i in range(1_500_000)), b"x" * 10_000_000])
def test_a_long_text_needs_memory_in_proportion(text):
    tracemalloc.start()
    row = runs._piece([3], [text], 24, 3, runs.planted, False)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = text.count(b" ") + (not text.endswith(b" "))
    assert row[1] == n and peak < 40 * len(text), peak / len(text)
    if text.startswith(b"word"):
        assert row[2:7] == (1, 0, n, 1, 1000 * n)
