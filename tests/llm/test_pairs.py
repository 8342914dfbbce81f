"""Links inside of clusters: no link is lost, and families under the threshold stay cheap."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext

from trackframe.llm import common, pairs

from .test_dedup import union


def alike(a, b):
    return 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))


def family(n, shared, own=180, seed=1, pool=None):
    """Sets of ``own`` values that have ``shared`` ones in common; the others are their own, or drawn from a pool."""
    rng = np.random.default_rng(seed)
    rest = lambda i: 10**6 * seed + (i * own + np.arange(own - shared) if pool is None else rng.integers(0, pool, own - shared))
    return [np.unique(np.concatenate([np.arange(shared), rest(i)])).astype(np.int64) for i in range(n)]


@pytest.mark.parametrize("rounds, columns, cells", [(0, 2, 16), (1, 8, 1 << 21), (4, 2048, 1 << 21), (0, 2048, 64)])
def test_labels_are_those_of_all_pairs(monkeypatch, rounds, columns, cells):
    for name, x in (("ROUNDS", rounds), ("COLUMNS", columns), ("PAIRS", cells), ("COMPARED", 50)):
        monkeypatch.setattr(pairs, name, x)
    r = random.Random(rounds + columns)
    for _ in range(60):
        n, base = r.randint(1, 40), [r.sample(range(200), r.randint(5, 30)) for _ in range(4)]
        sets = []
        for _ in range(n):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 6)):
                s = s | {r.randint(0, 260)} if r.random() < 0.5 or len(s) < 4 else s - {r.choice(sorted(s))}
            sets.append(np.array(sorted(s), dtype=np.int64))
        key = np.array([r.randint(0, 3) if k % 2 else 9 for k in range(2 * n)])  # all share bucket 9
        got = pairs.linked(sets, np.repeat(np.arange(n), 2), key, 80, 100).tolist()
        root = union(n, [(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j])])
        assert got == [min(j for j in range(n) if root[j] == root[i]) for i in range(n)]


@pytest.mark.parametrize("shared, pool", [(140, None), (155, None), (158, 400_000)])
def test_a_family_without_links_is_cheap(shared, pool):
    """16,384 sets of Jaccard 0.64 to 0.78, all in shared buckets."""
    n = 16384
    sets = family(n, shared, pool=pool)
    key = np.random.default_rng(2).integers(0, 8, 5 * n)
    tracemalloc.start()
    began = time.process_time()
    label = pairs.linked(sets, np.repeat(np.arange(n), 5), key, 80, 100)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 60 and peak < 500 << 20
    if pool is None:
        assert len(np.unique(label)) == n
    else:
        some = np.flatnonzero(np.bincount(label, minlength=n) > 1)[:50]
        assert len(some) and all(any(alike(sets[i], sets[j]) for j in np.flatnonzero(label == i) if j != i) for i in some)


@pytest.mark.parametrize("values", [2_000_000, 3000])
def test_a_large_cluster_goes_by_blocks(spark, monkeypatch, values):
    """A family without links, one whose neighbours are linked in a chain, and copies of a few; one bucket holds them all."""
    monkeypatch.setattr(common, "CLUSTER", 1)
    monkeypatch.setattr(common, "BLOCK_VALUES", values)
    sets = family(150, 140) + family(100, 155, seed=3)
    sets += [np.arange(5000 + 3 * i, 5100 + 3 * i, dtype=np.int64) for i in range(40)]  # each like the next ones only
    near = [np.arange(50_000, 50_100, dtype=np.int64)] + [np.append(np.arange(50_000, 50_099), 60_000 + i).astype(np.int64) for i in range(60)]
    sets += near
    ids = [int(x) for x in np.random.default_rng(4).permutation(len(sets)) + 7]
    rows = [(i, len(s), s.tolist()) for i, s in zip(ids, sets)]
    members = spark.createDataFrame([(k, i) for i in ids for k in (1, 2 + i % 2)], "key long, id long")
    banded = lambda s: np.zeros((len(s), 1), dtype=np.uint64)  # noqa: E731  (only for clusters of one task)
    got = dict(map(tuple, common.link_components(members, spark.createDataFrame(rows, "id long, n long, s array<long>"), 80, 100, banded).collect()))
    root = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    least = {}
    for i, c in zip(ids, root):
        least[c] = min(i, least.get(c, i))
    assert all(got.get(i, i) == least[c] for i, c in zip(ids, root))
    assert len(set(least.values())) == 150 + 100 + 1 + 1


def test_pairs_of_blocks_of_one_cluster_are_dealt_to_many_tasks(spark, monkeypatch):
    """Also where the rows of a cluster lie together after a sorted join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(common, "BLOCK_VALUES", 2000)
        tasks, own = [], common.save

        def told(num, den):
            def run(t):
                return pa.table({"a": pa.array([TaskContext.get().partitionId()], pa.int64()), "b": t.column("block").slice(0, 1).cast(pa.int64())})

            return run

        def save(df, name):
            if name == "links":
                tasks.extend(r.a for r in df.collect())
            return own(df, name)

        monkeypatch.setattr(common, "_compared", told)
        monkeypatch.setattr(common, "save", save)
        sets = family(120, 150)
        rows = [(1, i, s.tolist()) for i, s in enumerate(sets)]
        members = spark.createDataFrame([(5, i) for i in range(len(sets))], "key long, id long")
        common.links_by_blocks(members, spark.createDataFrame(rows, "cluster long, id long, s array<long>"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) == 66 and len(set(tasks)) > 10  # eleven blocks
