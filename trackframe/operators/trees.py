"""Digests of ordered rows as hash trees, global ordinals and ordered snapshots.

A tree has fan-out k: a node of level l + 1 is the SHA-256 over its at most k children's digests in order. So the digest depends on the rows'
order and k only, however rows are dealt to tasks; no group has more than k rows; the levels shrink by k each. A row is proved to be
in a tree by its siblings along one path, and two trees are compared from the root down, only where nodes differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

FAN_OUT = 256


def ordinals(df: DataFrame, order: Sequence, name: str = "ordinal") -> DataFrame:
    """Adds each row's place (from 0) in the order of all rows.

    Rows are dealt to ranges and sorted there; a prefix sum over the ranges' numbers of rows, a table of one row a range, gives each its first place.
    The ranges are written to the shared folder before they are counted, so that a task that runs again changes nothing. ``order`` should tell all rows apart."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    part = staged(part.withColumns({"__range": F.shiftright(mid, 33), "__at": mid.bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = part.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return part.join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def _parents(level: DataFrame, fan_out: int) -> DataFrame:
    children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])  # fan_out at most
    up = level.groupBy(F.floor(F.col("node") / fan_out).alias("node")).agg(F.sha2(F.array_join(children, ""), 256).alias("digest"), F.sum("n").alias("n"))
    return up.select((F.lit(1)).alias("level"), "node", "digest", "n")


def tree(rows: DataFrame, ordinal: str, row: Column, fan_out: int = FAN_OUT) -> DataFrame:
    """level, node, digest, n (rows below) of every node. Level 0 has a node for each row: node is its ordinal (0, 1, 2, ...), digest the SHA-256 of
    ``row``'s text. The last level has one node, the root. Without rows there is no node."""
    now = staged(rows.select(F.lit(0).alias("level"), F.col(ordinal).cast("long").alias("node"), F.sha2(row.cast("string"), 256).alias("digest"), F.lit(1).cast("long").alias("n")), "tree")
    out, level, n = now, 0, now.count()
    while n > 1:
        level, n = level + 1, -(-n // fan_out)
        now = staged(_parents(now, fan_out).withColumn("level", F.lit(level)), "tree")
        out = out.unionByName(now)
    return out


def root(nodes: DataFrame) -> DataFrame:
    """One row: digest, n and n_levels of a tree (no row without rows)."""
    return nodes.orderBy(F.desc("level")).limit(1).select("digest", "n", (F.col("level") + 1).alias("n_levels"))


def proofs(nodes: DataFrame, wanted: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Inclusion proofs of the rows of ``wanted`` (a column ordinal): ordinal, level, place and siblings (the digests of the node's parent's children,
    its own among them at ``place``), a row for each level below the root."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    out, spark = None, nodes.sparkSession
    for level in range(top):
        width = fan_out**level
        path = wanted.select(F.col("ordinal"), F.floor(F.col("ordinal") / width).alias("__node")).withColumn("__up", F.floor(F.col("__node") / fan_out))
        own = nodes.where(F.col("level") == level).select(F.floor(F.col("node") / fan_out).alias("__up"), "node", "digest")
        own = own.join(path.select("__up").distinct(), "__up", "left_semi").groupBy("__up").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]).alias("siblings"))
        got = path.join(own, "__up").select("ordinal", F.lit(level).alias("level"), (F.col("__node") % fan_out).cast("int").alias("place"), "siblings")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "ordinal long, level int, place int, siblings array<string>")


def proved(proof: DataFrame, claims: DataFrame, root_digest: str, fan_out: int = FAN_OUT) -> DataFrame:
    """ordinal, ok: whether the row digests of ``claims`` (ordinal, digest) are in the tree with this root by their proofs."""
    steps = F.array_sort(F.collect_list(F.struct("level", "place", "siblings")))
    per = claims.join(proof.groupBy("ordinal").agg(steps.alias("steps")), "ordinal", "left")

    def step(state, x):
        holds = state["ok"] & (F.try_element_at(x["siblings"], x["place"] + 1) == state["digest"]) & (x["place"] == state["node"] % fan_out)
        return F.struct(F.coalesce(holds, F.lit(False)).alias("ok"), F.sha2(F.array_join(x["siblings"], ""), 256).alias("digest"), F.floor(state["node"] / fan_out).alias("node"))

    first = F.struct(F.lit(True).alias("ok"), F.col("digest").alias("digest"), F.col("ordinal").alias("node"))
    end = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,place:int,siblings:array<string>>>")), first, step)
    return per.withColumn("__end", end).select("ordinal", (F.col("__end.ok") & (F.col("__end.digest") == root_digest)).alias("ok"))


def differing(left: DataFrame, right: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Ordinals at which two trees differ, from the root down: ordinal, left, right (row digests; null on a side without the row).

    A level's nodes are only read below nodes of the level above that differ, so equal parts cost nothing below their common
    ancestor. Trees of different height are compared from the lower one's root on, whose node is then compared with the other's first one."""
    tops = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    known = [t for t in tops if t is not None]
    open_ = None
    for level in range(max(known, default=-1), -1, -1):
        a, b = (t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((left, "left"), (right, "right")))
        if open_ is not None:
            a, b = (t.withColumn("__up", F.floor(F.col("node") / fan_out)).join(open_, "__up", "left_semi").drop("__up") for t in (a, b))
        both = a.join(b, "node", "full").where(~F.col("left").eqNullSafe(F.col("right")))
        if not level:
            return both.select(F.col("node").alias("ordinal"), "left", "right")
        open_ = staged(both.select(F.col("node").alias("__up")), "differing")
    return left.sparkSession.createDataFrame([], "ordinal long, left string, right string")


def offsets(rows: DataFrame, ordinal: str, n_bytes: Column, fan_out: int = 1 << 16) -> DataFrame:
    """Adds offset: the sum of ``n_bytes`` over all rows before, by a prefix sum in runs of ``fan_out`` ordinals and one over the runs."""
    rows = rows.withColumns({"__n": n_bytes.cast("long"), "__run": F.floor(F.col(ordinal) / fan_out)})
    runs = rows.groupBy("__run").agg(F.sum("__n").alias("__s"))
    runs = runs.withColumn("__high", F.floor(F.col("__run") / fan_out))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__high").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = runs.groupBy("__high").agg(F.sum("__s").alias("__t"))
    over = F.coalesce(F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for 2^32 ordinals
    runs = runs.withColumn("__b", before).join(F.broadcast(high.withColumn("__o", over).drop("__t")), "__high").select("__run", (F.col("__b") + F.col("__o")).alias("__before"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__run").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__w", within).join(runs, "__run").withColumn("offset", F.col("__before") + F.col("__w")).drop("__n", "__run", "__before", "__w")


def snapshot(parts: Sequence[DataFrame], order: Sequence[str], text: Column, path: str, most_bytes: int, fan_out: int = FAN_OUT) -> DataFrame:
    """Writes the ordered union of ``parts`` (equal columns) as one snapshot: text lines under path + "/lines" in order, path + "/index" with every row's ordinal, offset and
    n_bytes in the lines taken as one stream, and, last, path + "/header" with n_rows, n_bytes and the tree digest of the lines. Returns the header.

    A snapshot of over ``most_bytes`` fails before any of the three is written; without a header nothing counts. ``text`` holds no line feed."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    placed = ordinals(rows.withColumn("__text", text), order)
    placed = staged(offsets(placed, "ordinal", F.octet_length("__text") + 1).withColumn("n_bytes", (F.octet_length("__text") + 1).cast("long")), "snapshot")
    total = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.count_if(F.col("__text").contains("\n")).alias("feeds"), F.count_if(F.col("__text").isNull()).alias("nulls")).first()
    if (total["b"] or 0) > most_bytes:
        raise ValueError(f"the snapshot has {total['b']} bytes, over {most_bytes}")
    if total["feeds"] or total["nulls"]:
        raise ValueError("a line is null or holds a line feed")
    placed.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("__text").write.mode("errorifexists").text(path + "/lines")
    placed.drop("__text").write.mode("errorifexists").parquet(path + "/index")
    digest = root(tree(placed, "ordinal", F.col("__text"), fan_out)).select("digest")
    spark = rows.sparkSession
    n = F.lit(total["n"]).cast("long").alias("n_rows"), F.lit(total["b"] or 0).cast("long").alias("n_bytes")
    header = spark.range(1).select(*n).join(F.broadcast(digest), F.lit(True), "left")
    header.write.mode("errorifexists").parquet(path + "/header")
    return spark.read.parquet(path + "/header")
