"""Hash trees, ordinals, snapshots: fixed by the rows and their order alone."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trackframe.operators import trees
from trackframe.sources import streams


def plain_tree(texts, k):
    level, out = [hashlib.sha256(t.encode()).hexdigest() for t in texts], []
    while level:
        out.append(level)
        if len(level) == 1:
            break
        level = [hashlib.sha256("".join(level[i : i + k]).encode()).hexdigest() for i in range(0, len(level), k)]
    return out


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ordinal long, text string").repartition(parts)


@pytest.mark.parametrize("n, k", [(1, 4), (4, 4), (5, 4), (64, 4), (65, 4), (30, 256), (130, 11)])
def test_tree_is_the_plain_one_for_any_partitioning(spark, n, k):
    texts = [f"row {i * 7 % 13}" for i in range(n)]
    want = plain_tree(texts, k)
    for parts in (1, 5):
        got = trees.tree(frame(spark, texts, parts), "ordinal", F.col("text"), k)
        rows = sorted((r.level, r.node, r.digest) for r in got.collect())
        assert rows == [(lv, i, x) for lv, level in enumerate(want) for i, x in enumerate(level)]
        (top,) = trees.root(got).collect()
        assert (top.digest, top.n, top.n_levels) == (want[-1][0], n, len(want))


def test_no_rows_no_root(spark):
    t = trees.tree(frame(spark, ["x"]).limit(0), "ordinal", F.col("text"))
    assert t.count() == trees.root(t).count() == 0
    other = trees.tree(frame(spark, ["x"]), "ordinal", F.col("text"))
    assert [tuple(r)[0] for r in trees.differing(t, other).collect()] == [0] and trees.differing(t, t).count() == 0


def test_proofs(spark):
    texts = [f"row {i}" for i in range(75)]
    t = trees.tree(frame(spark, texts), "ordinal", F.col("text"), 4)
    wanted = spark.createDataFrame([(0,), (17,), (74,)], "ordinal long")
    p = trees.proofs(t, wanted, 4)
    top = trees.root(t).first()["digest"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    claims = spark.createDataFrame([(0, sha("row 0")), (17, sha("row 18")), (74, sha("row 74")), (3, sha("row 3"))], "ordinal long, digest string")
    assert {r.ordinal: r.ok for r in trees.proved(p, claims, top, 4).collect()} == {0: True, 17: False, 74: True, 3: False}
    moved = p.withColumn("ordinal", F.when(F.col("ordinal") == 17, 16).otherwise(F.col("ordinal")))  # a proof of another place
    claims = spark.createDataFrame([(16, sha("row 17"))], "ordinal long, digest string")
    assert not trees.proved(moved, claims, top, 4).first()["ok"]
    assert p.groupBy("ordinal").count().agg(F.max("count")).first()[0] == 4  # 75 rows, fan-out 4


@pytest.mark.parametrize("change", [{}, {3: "x"}, {0: "x", 61: "y", 99: "z"}, {100: "new"}, {i: "n" for i in range(100, 300)}])
def test_differences_of_two_trees(spark, change):
    a = [f"row {i}" for i in range(100)]
    b = list(a)
    for i, x in sorted(change.items()):
        b[i : i + 1] = [x]
    x, y = (trees.tree(frame(spark, t), "ordinal", F.col("text"), 5) for t in (a, b))
    for left, right, l, r in ((x, y, a, b), (y, x, b, a)):
        got = sorted(trees.differing(left, right, 5).collect())
        assert [v.ordinal for v in got] == sorted(change)
        assert [(v.left is None, v.right is None) for v in got] == [(i >= len(l), i >= len(r)) for i in sorted(change)]


def test_ordinals_with_ties_and_skew(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") < 600, 7).otherwise(F.col("id")).alias("b"), "id")
    got = trees.ordinals(df.repartition(7), ["a", "b", "id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.ordinal)] == sorted(range(1000), key=lambda i: (i % 3, 7 if i < 600 else i, i))
    assert sorted(r.ordinal for r in got) == list(range(1000))
    assert trees.ordinals(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("run", [1, 4, 1000])
def test_offsets(spark, run):
    df = spark.range(50).select(F.col("id").alias("ordinal"), (F.col("id") * 3 % 7).alias("size")).repartition(4)
    got = {r.ordinal: r.offset for r in trees.offsets(df, "ordinal", F.col("size"), run).collect()}
    assert got == {i: sum(j * 3 % 7 for j in range(i)) for i in range(50)}


def test_snapshot(spark, tmp_path):
    a, b = (spark.range(n).select(F.lit(k).alias("kind"), "id", F.concat(F.lit("é" * k), F.col("id").cast("string")).alias("t")) for k, n in ((0, 30), (1, 20)))
    want = [str(i) for i in range(30)] + [f"é{i}" for i in range(20)]
    raw = "".join(x + "\n" for x in want).encode()
    with pytest.raises(ValueError, match="over"):
        trees.snapshot([a, b], ["kind", "id"], F.col("t"), f"{tmp_path}/no", len(raw) - 1)
    assert not os.path.exists(tmp_path / "no")
    with pytest.raises(ValueError, match="line feed"):
        trees.snapshot([a], ["id"], F.lit("a\nb"), f"{tmp_path}/no", 1 << 20)
    (head,) = trees.snapshot([b, a], ["kind", "id"], F.col("t"), f"{tmp_path}/s", len(raw), 8).collect()
    assert (head.n_rows, head.n_bytes, head.digest) == (50, len(raw), plain_tree(want, 8)[-1][0])
    (s,) = streams.streams(f"{tmp_path}/s/lines", together=True)
    assert s.read(0, s.size) == raw
    for r in spark.read.parquet(f"{tmp_path}/s/index").collect():
        assert s.read(r.offset, r.n_bytes).decode() == want[r.ordinal] + "\n"
    with pytest.raises(Exception, match="exist"):
        trees.snapshot([a], ["id"], F.col("t"), f"{tmp_path}/s", 1 << 20)
    (none,) = trees.snapshot([a.limit(0)], ["id"], F.col("t"), f"{tmp_path}/empty", 0).collect()
    assert (none.n_rows, none.n_bytes, none.digest) == (0, 0, None)
