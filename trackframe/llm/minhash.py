"""MinHash near-duplicates by fast similarity sketching.

Each document's set of word shingles gets a sketch of ``bands * rows`` coordinates (rounds
of hashed bin placement, kernels.sketch); bands of ``rows`` coordinates are dealt to buckets,
and documents that share a band are compared on their full sets. A pair at the threshold of
0.8 shares none of 32 bands of 4 with probability (1 - 0.8^4)^32 < 1e-7.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are
their own component. A text with fewer words than a shingle has one shingle, its whole
sequence. Rows with equal doc_id are separate nodes of the same name; rows without a doc_id
link others but name a component only if no row with an id is in it (component null). Extra
columns are ignored. Sets are compared by 54-bit shingle hashes, and documents with equal
sets are one node, named by a 64-bit hash of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .common import BROADCAST_IDS, link_components, save, save_seen, shuffle_width, table

_PASS = "doc_id long, n long, h long, bucket int, kind tinyint, blob binary"


_NAMES = ["doc_id", "n", "h", "bucket", "kind", "blob"]


def _dealt(rows):
    b, kind, blob = zip(*rows)
    none = pa.nulls(len(rows), pa.int64())
    return pa.record_batch([none, none, none, pa.array(b, pa.int32()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())], names=_NAMES)


def _sketches(k: int, n_bands: int, rows: int, n_buckets: int):
    def run(batches):
        dealer = K.Dealer(n_buckets)
        for batch in batches:
            ids, texts = batch.column(0), K.texts(batch.column(1))
            for i, j in K.pieces([len(t) for t in texts]):
                x, bounds = K.doc_shingles(texts[i:j], k)
                h = K.set_ids(x, bounds)
                n = np.diff(bounds)
                none = pa.nulls(j - i)
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array(n), pa.array(h.view(np.int64), mask=n == 0), none.cast(pa.int32()), none.cast(pa.int8()), none.cast(pa.binary())],
                    names=_NAMES,
                )
                # equal sets in this piece are sketched once
                at = np.unique(h, return_index=True)[1]
                at = at[n[at] > 0]
                if len(at) < j - i:
                    x = np.concatenate([x[bounds[a] : bounds[a + 1]] for a in at]) if len(at) else x[:0]
                else:
                    at = np.arange(j - i)
                owner = np.repeat(np.arange(len(at), dtype=np.int32), n[at])
                due = dealer.add(K.bands(K.sketch(x, owner, len(at), n_bands * rows), rows), h[at])
                if due:
                    yield _dealt(due)
        due = dealer.flush()
        if due:
            yield _dealt(due)

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            texts = K.texts(batch.column(0))
            for i, j in K.pieces([len(t) for t in texts]):
                x, bounds = K.doc_shingles(texts[i:j], k)
                n = np.diff(bounds)
                flat = pa.array(x.view(np.int64))
                s = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
                yield pa.record_batch([pa.array(K.set_ids(x, bounds).view(np.int64), mask=n == 0), pa.array(n), s], names=["id", "n", "s"])

    return run


def _banded(n_bands: int, rows: int):
    """Sets to the keys that _sketches deals."""

    def run(sets):
        x, owner = np.concatenate(sets).view(K.U), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        return K.bands(K.sketch(x, owner, len(sets), n_bands * rows), rows)

    return run


def _named(k: int):
    def run(batches):
        for batch in batches:
            texts = K.texts(batch.column("text"))
            n, h = [], []
            for i, j in K.pieces([len(t) for t in texts]):
                x, bounds = K.doc_shingles(texts[i:j], k)
                n.append(np.diff(bounds))
                h.append(K.set_ids(x, bounds))
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            h = np.concatenate(h) if h else np.zeros(0, K.U)
            yield batch.append_column("__h", pa.array(h.view(np.int64), mask=n == 0))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, n_bands: int = 32, rows: int = 4) -> DataFrame:
    """Classes of near-duplicate documents: one row per row of ``docs`` (doc_id, text).

    Returns doc_id, n_shingles, set_id (null for an empty set), component_id, kept.
    Documents are linked if den * |intersection| >= num * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = 4 * shuffle_width(spark)
    first = save(docs.mapInArrow(_sketches(shingle, n_bands, rows, n_buckets), _PASS), "sketches")
    named = first.where("bucket is null").select("doc_id", "n", "h")
    blobs = first.where("bucket is not null").select("bucket", "kind", "blob")
    size = blobs.agg(F.sum(F.length("blob"))).first()[0] or 0
    members = save(
        blobs.repartition(shuffle_width(spark, size), "bucket").mapInArrow(K.shared_entries, "key long, id long").distinct(), "members"
    )
    # the text of one document for each set that is in a shared bucket
    wanted = members.select(F.col("id").alias("h")).distinct()
    picked = named.where("h is not null").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("lost"))
    ids, (n_ids,) = save_seen(picked.where("doc_id is not null").select("doc_id").distinct(), "candidates", F.count(F.lit(1)))
    if n_ids <= BROADCAST_IDS:  # else both sides are shuffled
        ids = F.broadcast(ids)
    found = docs.join(ids, "doc_id", "left_semi").select("text")
    if not picked.where("doc_id is null").isEmpty():  # sets that only documents without an id have
        found = found.unionByName(docs.where("doc_id is null").select("text"))
    sets = save(found.mapInArrow(_sets(shingle), "id long, n long, s array<long>"), "sets")
    comp = link_components(members, sets, num, den, _banded(n_bands, rows))
    nodes = named.join(comp.withColumnRenamed("id", "h"), "h", "left").withColumn("c", F.coalesce("comp", "h"))
    least = nodes.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    least = save(least, "least")  # written, so that Spark can split a skewed side of the join
    return nodes.join(least, "c", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("h").alias("set_id"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).alias("kept"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return r.select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near-duplicates (five words, 0.8) stays.

    Only rows that share their id with one that goes, or with an equal one, are looked at again; texts aren't shuffled if
    those ids are few."""
    r = near_duplicates(docs).where("set_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("set_id").alias("__set"))
    r = r.agg(F.count(F.lit(1)).alias("__n"), F.bool_or("kept").alias("__kept")).where("__n > 1 or not __kept")
    r, (n, again) = save_seen(r, "gone", F.count(F.lit(1)), F.count_if(F.expr("__n > 1 and __kept")))
    ids, sets = r.select(F.col("__id").alias("__i")).distinct(), r
    if n <= BROADCAST_IDS:  # else both sides are shuffled
        ids, sets = F.broadcast(ids), F.broadcast(r)
    here = docs["doc_id"].eqNullSafe(F.col("__i"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clean = docs.join(ids, here, "left_anti")
    named = docs.join(ids, here, "left_semi").mapInArrow(_named(5), StructType([*docs.schema.fields, StructField("__h", LongType())]))
    j = named.join(sets, named["doc_id"].eqNullSafe(F.col("__id")) & (named["__h"] == F.col("__set")), "left").drop("__id", "__set")
    rest = clean.unionByName(j.where("__n is null").select(*columns))
    if not again:
        return rest
    return rest.unionByName(j.where("__n > 1 and __kept").dropDuplicates(["doc_id", "__h"]).select(*columns))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
    FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
cnt AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM cnt JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * i >= 80 * (x.c + y.c - i)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, b AS other FROM e
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
