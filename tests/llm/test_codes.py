"""Vector codes and SimHash classes against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackframe.llm import common, simhash, vector_codes

from .test_dedup import WORD, frame, union

# --- vector codes ---


def plain_codes(rows, entries, rounds):
    """(vec_id, label, vector) rows by plain Python."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    dim = len(kept[0][2]) // 16
    parts = [[[math.floor(256 * x) for x in v[p * dim : (p + 1) * dim]] for p in range(16)] for *_, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[parts[i][p] for i in first] for p in range(16)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(first)), key=lambda e: (away(books[p][e], x), e))
    for _ in range(rounds):
        for p in range(16):
            own = defaultdict(list)
            for x in parts:
                own[nearest(p, x[p])].append(x[p])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    codes = [[nearest(p, x[p]) for p in range(16)] for x in parts]
    errors = [sum(away(books[p][c[p]], x[p]) for p in range(16)) for x, c in zip(parts, codes)]
    by = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in c), e, by[label], digest) for (i, label, _), c, e in zip(kept, codes, errors)]


def vectors(n=150, dim=48, seed=4):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 2, None]), [round(r.gauss(0, 0.3), 2) for _ in range(dim)]) for i in range(n)]
    rows += [(500, 1, None), (501, 1, [0.1] * (dim - 1) + [None]), (502, 2, [0.1] * (dim - 1) + [math.nan]), (503, 2, [math.inf] + [0.1] * (dim - 1)), (504, None, [0.0] * dim)]
    return rows + [rows[3], rows[3], (7, 2, [-0.5] * dim), (None, 1, [0.25] * dim), (600, 3, [40000.0] * dim)]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("entries, rounds", [(64, 2), (9, 3), (500, 1)])
def test_codes_are_those_of_a_full_search(spark, entries, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("l", F.lit(0)).repartition(3)
    got = vector_codes.vector_codes(df, entries, rounds).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_codes(rows, entries, rounds)))


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, vector_codes.vector_codes(spark.createDataFrame(vectors(), SCHEMA)).where("vec_id >= 0").collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, vector_codes.vector_codes(spark.createDataFrame(vectors(), SCHEMA)).where("vec_id >= 0").collect())) == want


def test_no_vector_and_odd_lengths(spark):
    none = spark.createDataFrame([(1, 1, None), (2, 1, [math.nan] * 16)], SCHEMA)
    assert vector_codes.vector_codes(none).count() == 0 and vector_codes.vector_codes(none.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, 0, [float(i)] * 17) for i in range(5)] + [(9, 0, [1.0] * 16)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2, 3, 4] and {r.error for r in got} == {0}


def test_bounds_hold_and_most_entries_are_never_refined():
    r = np.random.default_rng(3)
    book = vector_codes.Approximation(r.integers(-200, 200, (64, 4)))
    q = r.integers(-250, 250, (300, 4))
    exact = ((q[:, None] - book.entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.35
    code, error = book.nearest(q)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


# --- SimHash ---


def plain_fingerprint(text, k=3):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts(seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(60, 300))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "two words"), (8, "Two\twords"), (9, "x " * 40000)]
    for i in range(150):
        ws = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 9])):
            ws[r.randrange(len(ws))] = r.choice(words)
        rows.append((20 + i, r.choice([" ", "\n\n"]).join(ws)))
    return rows + [rows[30], rows[30], (None, rows[31][1]), (None, "nothing else"), (None, "")]


def expected_classes(rows, k=3, distance=2):
    fps = [plain_fingerprint(t, k) for _, t in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance])
    least = {}
    for (i, _), c in zip(rows, root):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, f, least[c]) for (i, _), f, c in zip(rows, fps, root)), key=str)


@pytest.mark.parametrize("way", ["plain", "dynamic", "whole", "shuffled"])
def test_classes_are_those_of_brute_force(spark, monkeypatch, way):
    if way == "dynamic":  # thresholds of 0 in all parts are never taken for best without looking
        monkeypatch.setattr(simhash, "PROBE", 0)
    elif way == "whole":  # every fingerprint is looked up itself
        monkeypatch.setattr(simhash, "allocated", lambda values, groups, counts, distance: np.full((len(values[0]), len(groups)), -2, dtype=np.int8))
    elif way == "shuffled":
        monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
        monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rows = texts()
    docs = frame(spark, rows).withColumn("fp", F.lit("clash")).withColumn("part", F.lit(0)).repartition(3)
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = expected_classes(rows)
    assert sorted(got, key=str) == want
    assert len({c for *_, c in want}) < len(want) - 30


@pytest.mark.parametrize("distance, parts", [(1, 2), (2, 4), (3, 4), (3, 3), (0, 1)])
def test_no_link_is_lost(spark, distance, parts):
    """Families around few centres, one of which fills most of each part's commonest value."""
    r = np.random.default_rng(distance + parts)
    centre = r.integers(-(2**62), 2**62, 20)
    x = centre[np.minimum(r.geometric(0.3, 1500) - 1, 19)]
    for _ in range(3):
        x = x ^ np.where(r.random(1500) < 0.7, 1 << r.integers(0, 63, 1500), 0)
    x = np.unique(np.concatenate([x, r.integers(-(2**62), 2**62, 300)]))
    fps = common.save(spark.createDataFrame([(int(v),) for v in x], "fp long"), "test")
    got = {(r.a, r.b) for r in simhash.links(fps, distance, parts).collect()}
    away = np.bitwise_count(x[:, None] ^ x[None])
    a, b = np.nonzero((away <= distance) & (x[:, None] < x[None]))
    assert got == set(zip(x[a].tolist(), x[b].tolist()))


def test_thresholds_add_up_and_avoid_common_values():
    r = np.random.default_rng(1)
    groups = [list(range(i, 64, 3)) for i in range(3)]
    fp = r.integers(-(2**62), 2**62, 400)
    values = [simhash.part_values(fp, g) for g in groups]
    counts = np.zeros((3, simhash.BINS), dtype=np.int64)
    for p, v in enumerate(values):
        np.add.at(counts[p], simhash._bin(v), 1)
    counts[1][simhash._bin(values[1][:200])] += 10**6  # half of them have a value of the second part that very many have
    t = simhash.allocated(values, groups, counts, 2)
    assert (t.sum(axis=1) == 0).all() and (t[:200, 1] == -1).all() and (t[200:] == 0).all(axis=1).mean() > 0.97  # few share a bin with those
    counts += 10**6
    assert (simhash.allocated(values, groups, counts, 2) == -2).all()


def test_bits_that_go_together_share_a_part():
    r = np.random.default_rng(2)
    own = r.integers(0, 2, (4000, 16))
    x = np.concatenate([np.repeat(own[:, :2], 8, axis=1), own[:, 2:], r.integers(0, 2, (4000, 34))], axis=1).astype(float)
    groups = simhash.grouped_bits((x.T @ x).astype(int), len(x))
    assert sorted(b for g in groups for b in g) == list(range(64))
    held = [max(len(set(g) & set(same)) for g in groups) for same in (range(8), range(8, 16))]
    assert max(held) == 8 and min(held) >= 4  # a part may fill up inside of the second one


def test_fingerprints_of_empty_and_long_texts(spark):
    assert simhash.near_duplicates(frame(spark, texts()).limit(0)).count() == 0
    text = "abc de f " * 200_000
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)
