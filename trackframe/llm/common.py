"""Shared pieces of the corpus operators: shared storage, components, link search."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .pairs import Sets, linked


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset in a local
    session, as in tests, a temporary folder of this machine is made and set. On a cluster that is an error: its
    machines would not share the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[(?!.*,.*,)|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done.saved_at = path
    return done


def forget(df: DataFrame) -> None:
    """Deletes a table of save() that nothing reads again (the rounds of a loop, once the next one is written)."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def save_seen(df: DataFrame, name: str, *sums) -> tuple[DataFrame, list]:
    """save(), with aggregates of the rows taken while they are written."""
    seen = Observation()
    done = save(df.observe(seen, *[x.alias(f"s{i}") for i, x in enumerate(sums)]), name)
    got = seen.get
    return done, [got[f"s{i}"] for i in range(len(sums))]


#: Rows of an Arrow batch; Spark's default of 10,000 makes batches of long texts large.
BATCH_ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Unless the session has a setting of its own, Arrow batches get small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession, n_bytes: int = 0, target: int = 32 << 20) -> int:
    """Partitions for hand-dealt blobs: at least the session's, more for more bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // target))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has long columns a and b, a <> b. Returns (id, comp) for every node that has
    an edge; comp is the smallest id of the component. All state stays distributed; each
    round is written to the shared folder, so a lost executor costs one round at most.

    The edges of a node never gather: minima are taken in the map tasks first, and the table of minima is broadcast where it
    is small; beyond that the join of edges and minima has one row a node on one side, so Spark can split a node with many edges.
    Edges with a null are no edges.
    """
    sums = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e, seen = save_seen(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", *sums
    )

    def small_side(least):  # at most a row for each end of an edge
        return F.broadcast(least) if seen[0] <= BROADCAST_IDS else least

    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(small_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_side(least), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before = e
        e, now = save_seen(small, "edges", *sums)
        forget(before)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets have den * |intersection| >= num * |union|."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    na, nb = F.size("sa").cast("long"), F.size("sb").cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(den * F.least(na, nb) >= num * F.greatest(na, nb))
        .where(den * both >= num * (na + nb - both))
        .select("a", "b")
    )


#: Rows of ids that may be broadcast (a few MB).
BROADCAST_IDS = 200_000
#: Clusters of candidates up to these sizes are solved in one task's memory.
CLUSTER, CLUSTER_VALUES = 16384, 4_000_000
#: Values of a block of sets; a task holds two blocks.
BLOCK_VALUES = 2_000_000
#: Tasks that pairs of blocks are dealt to; more pairs share them.
MOST_TASKS = 4096


def arrays(lists: pa.Array) -> list[np.ndarray]:
    flat, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _solved(num: int, den: int, unpack, banded):
    """Rows (cluster, id, s) sorted by cluster to (id, comp); whole clusters, several at once."""

    def solve(t: pa.Table):
        t = t.combine_chunks()
        ids, at = np.unique(t.column("id").to_numpy(), return_index=True)
        t = t.take(pa.array(at)).combine_chunks()
        sets = unpack(t.column("s").chunk(0))
        keys = banded(sets)
        label = linked(sets, np.repeat(np.arange(len(ids)), keys.shape[1]), keys.ravel(), num, den)
        n = np.bincount(label, minlength=len(label))[label]
        return pa.record_batch([pa.array(ids[n > 1]), pa.array(ids[label[n > 1]])], names=["id", "comp"])

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= 4096 or size > 8 << 20:
                t = pa.Table.from_batches(held)
                c = t.column("cluster").to_numpy()
                cut = int(np.searchsorted(c, cluster[-1]))  # the last cluster may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows, size = len(c) - cut, sum(x.nbytes for x in held)
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _as_arrays(unpack):
    def run(batches):
        for batch in batches:
            got = unpack(batch.column("s"))
            yield pa.record_batch([batch.column("id"), pa.array([x.view(np.int64) for x in got], pa.list_(pa.int64()))], names=["id", "s"])

    return run


def link_components(members: DataFrame, sets: DataFrame, num: int, den: int, banded, unpack=arrays) -> DataFrame:
    """Components of the graph of verified links between members of shared buckets.

    members: distinct (key, id): the candidate buckets with two ids or more.
    sets: (id, n, s): the full set of every id in members, of about n values; rows may repeat, and there
    may be more. unpack turns an Arrow array of s into arrays of different 64-bit values, banded a list of
    those into their bucket keys (sets x bands), the keys of members.

    Buckets that overlap form clusters of candidates. A cluster of bounded size goes to one
    task, which compares its members on their full sets (each shipped once). Larger clusters,
    such as one of a third of all rows, are solved by links_by_blocks over all executors.
    Returns (id, comp) for ids with a link; comp is the smallest id linked. A null key or id is in no bucket.
    """
    spark = members.sparkSession
    lead = members.groupBy("key").agg(F.min("id").alias("leader"))
    cluster = components(members.join(lead, "key").select(F.col("leader").alias("a"), F.col("id").alias("b")))
    cluster, (n_ids,) = save_seen(cluster.select("id", F.col("comp").alias("cluster")), "clusters", F.count(F.lit(1)))
    every = cluster
    known = F.broadcast(cluster) if n_ids <= BROADCAST_IDS else cluster  # else both sides are shuffled
    sizes = sets.select("id", "n").join(known, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("v"))
    sizes, (n_large, values) = save_seen(
        sizes.withColumn("large", (F.col("m") > CLUSTER) | (F.col("v") > CLUSTER_VALUES)), "sizes", F.count_if("large"), F.sum("v")
    )
    if n_large:
        cluster = cluster.join(sizes.where("large").select("cluster", "large"), "cluster", "left")
        ids = cluster.where("large").select("id")
        known = cluster.where("large is null").select("id", "cluster")
    small = sets.join(known, "id").select("cluster", "id", "s")
    width = shuffle_width(spark, 8 * (values or 0), 8 << 20)
    small = small.repartition(width, "cluster").sortWithinPartitions("cluster")
    found = save(small.mapInArrow(_solved(num, den, unpack, banded), "id long, comp long"), "linked")
    if not n_large:
        return found
    wide = sets.join(ids, "id", "left_semi").select("id", "s").dropDuplicates(["id"])
    wide = wide.mapInArrow(_as_arrays(unpack), "id long, s array<long>") if unpack is not arrays else wide
    wide = save(wide.join(every, "id").select("cluster", "id", "s"), "wide")
    return found.unionByName(links_by_blocks(save(members.join(ids, "id", "left_semi").select("key", "id"), "wide-members"), wide, num, den))


def _compared(num: int, den: int):
    """One pair of blocks (block, other, id, c, own, s): edges of the components of its links. c: ids known to be of one component."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, c = t.column("id").to_numpy(), t.column("c").to_numpy()
        s = Sets(arrays(t.column("s").chunk(0)), num, den)
        by = np.argsort(c, kind="stable")
        same = np.flatnonzero(c[by][1:] == c[by][:-1])
        s.merge(by[same], by[same + 1])
        was = s.label.copy()
        own = t.column("own").to_numpy(zero_copy_only=False)
        if t.column("block")[0].as_py() == t.column("other")[0].as_py():
            s.compare_all(np.arange(len(ids)))
        else:
            s.compare_all(np.flatnonzero(own), np.flatnonzero(~own))
        new = np.flatnonzero(s.label != was)
        return pa.table({"a": ids[new], "b": ids[s.label[new]]})

    return run


def links_by_blocks(members: DataFrame, sets: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """As link_components, without any cluster in one task; members and sets have the cluster too.

    First each bucket's smallest id is compared with the others (a star), so a bucket of n copies costs n comparisons. What is in a
    bucket that still holds two components is pruned (sets of which too few values are in another set of the cluster have no link), dealt to blocks of BLOCK_VALUES values, and
    every pair of blocks of a cluster is a task of its own, which compares all of its sets and returns the edges of their components, never pairs.
    """
    spark = members.sparkSession
    lead = members.groupBy("key").agg(F.min("id").alias("leader"))
    starred = members.join(lead, "key")
    pairs = save(starred.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    stars = save(_verified(pairs, sets, num, den), "stars")
    comp = save(components(stars), "components")
    named = starred.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("c"))
    open_ = named.groupBy("key").agg((F.min("c") < F.max("c")).alias("open")).where("open").select("key")
    active = named.join(open_, "key", "left_semi").groupBy("id").agg(F.min("c").alias("c"))
    active, (n,) = save_seen(active.join(sets, "id").select("cluster", "id", "c", "s"), "active", F.count(F.lit(1)))
    if not n:
        return comp
    values = active.select("cluster", "id", F.explode("s").alias("v"))
    shared = values.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "v")
    shared = values.join(save(shared, "shared"), ["cluster", "v"]).groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    active = save(active.join(shared, "id").where(den * F.col("shared") >= num * F.size("s")).drop("shared"), "active")
    blocks = active.groupBy("cluster").agg(F.ceil(F.sum(F.size("s")) / BLOCK_VALUES).cast("long").alias("blocks"))
    blocks, (n, pairs) = save_seen(blocks, "blocks", F.count(F.lit(1)), F.sum(F.expr("blocks * (blocks + 1) div 2")))
    if n <= BROADCAST_IDS:  # else both sides are shuffled
        blocks = F.broadcast(blocks)
    dealt = active.join(blocks, "cluster").withColumn("at", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("at", "with").alias("block"), F.greatest("at", "with").alias("other"), "id", "c", (F.col("at") <= F.col("with")).alias("own"), "s")
    # dealt anew: rows that lie by cluster would satisfy the grouping, and all pairs of a cluster be one task's
    dealt = dealt.repartition(max(shuffle_width(spark), min(2 * (pairs or 0), MOST_TASKS)), "cluster", "block", "other")
    found = dealt.groupBy("cluster", "block", "other").applyInArrow(_compared(num, den), "a long, b long")
    return components(save(stars.unionByName(found), "links"))
