"""Benchmark decontamination by a broadcast hash set of word windows.

Benchmark items become windows of ``window`` words (an item of fewer words is one window), hashed on the
executors; a sorted array of the hashes and the items' words are broadcast, documents' windows of each
occurring length are looked up, and every hit is verified word by word. What is broadcast is bounded: the driver
takes hashed items one after the other and closes a block at ``most`` windows (some 40 bytes each with the words); each block is
scanned in turn, and the hits of a document are merged.

Defined cases: null, empty and wordless texts have no words and no hits; a wordless or null
item has no window; repeated item ids count once; an item without an id marks words but isn't
counted or named; repeated rows give a result each; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import save, table

WINDOW = 10
#: Windows of one broadcast.
MOST = 1 << 20
_HITS = "doc_id long, tkey long, n_words long, n_hit long, items array<long>, spans array<struct<a:int,b:int>>"


def _word_hashes(parts: list[bytes]):
    buf, starts = K.joined(parts)
    buf = K.LOWER[buf]
    a, b = K.words(buf, K.PLAIN)
    return buf, a, b, K.owners(starts, a), K.spans(buf, a, b)


_ITEM = "item_id long, k int, hashes binary, starts binary, ends binary, words binary"


def _hashed_items(window: int):
    """(item_id, text) to the hashes of its windows, and where each starts and ends in its words joined by spaces."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), K.texts(batch.column(1))
            for i, j in K.pieces([len(t) for t in texts]):
                buf, a, b, doc, h = _word_hashes(texts[i:j])
                raw, cut, rows = buf.tobytes(), np.searchsorted(doc, np.arange(j - i + 1)), []
                for d in range(j - i):
                    x, y = cut[d], cut[d + 1]
                    k = int(min(y - x, window))
                    if not k:
                        continue
                    ends = np.cumsum(b[x:y] - a[x:y] + 1) - 1
                    starts = np.append(0, ends[:-1] + 1)
                    words = b" ".join([raw[p:q] for p, q in zip(a[x:y].tolist(), b[x:y].tolist())])
                    rows.append((ids[i + d].as_py(), k, K.rolled(h[x:y], k).tobytes(), starts[: y - x - k + 1].tobytes(), ends[k - 1 :].tobytes(), words))
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=["item_id", "k", "hashes", "starts", "ends", "words"])

    return run


def build_index(items: list) -> dict:
    """words: all items' words; by: for each window length (hashes, starts, ends, first, last), ascending by hash, a
    row for each different window; the ids of the items that have it are ids[first:last], named[first:last] says which aren't null."""
    words = b" ".join(r.words for r in items)
    base = np.cumsum([0] + [len(r.words) + 1 for r in items])
    index = {"words": words, "by": {}}
    ids, named, at = [], [], 0
    for k in sorted({r.k for r in items}):
        own = [i for i, r in enumerate(items) if r.k == k]
        h = np.concatenate([np.frombuffer(items[i].hashes, dtype=K.U) for i in own])
        a, b = (np.concatenate([np.frombuffer(getattr(items[i], c), dtype=np.int64) + base[i] for i in own]) for c in ("starts", "ends"))
        item = np.repeat(np.array([items[i].item_id or 0 for i in own], dtype=np.int64), [len(items[i].hashes) // 8 for i in own])
        known = np.repeat(np.array([items[i].item_id is not None for i in own]), [len(items[i].hashes) // 8 for i in own])
        order = np.argsort(h, kind="stable")
        h, a, b, item, known = h[order], a[order], b[order], item[order], known[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        for i in np.flatnonzero(~new).tolist():  # equal hashes: equal words but for a chance of 2^-64 a pair
            new[i] = words[a[i] : b[i]] != words[a[i - 1] : b[i - 1]]
        first = np.flatnonzero(new)
        index["by"][k] = (h[first], a[first], b[first], at + first, at + np.append(first[1:], len(h)))
        ids.append(item)
        named.append(known)
        at += len(h)
    index["ids"] = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    index["named"] = np.concatenate(named) if named else np.zeros(0, bool)
    return index


def indexes(benchmark: DataFrame, window: int, most: int):
    """Indexes of about ``most`` windows at most (but of one item at least), one after the other."""
    held, n = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    for r in items.mapInArrow(_hashed_items(window), _ITEM).toLocalIterator():
        held.append(r)
        n += len(r.hashes) // 8
        if n >= most:
            yield build_index(held)
            held, n = [], 0
    if held:
        yield build_index(held)


def _scan(shared):
    def run(batches):
        index = shared.value
        words, ids, named = index["words"], index["ids"], index["named"]
        for batch in batches:
            keys, tkeys, texts = batch.column(0), batch.column(1), K.texts(batch.column(2))
            for i, j in K.pieces([len(t) for t in texts]):
                buf, a, b, doc, h = _word_hashes(texts[i:j])
                raw = None
                hit = np.zeros(len(a), dtype=bool)
                items: dict[int, set] = {}
                for k, (sorted_, starts, ends, first, last) in index["by"].items():
                    rolled = K.rolled(h, k)
                    for x in range(0, len(rolled), K.LOW):
                        part = rolled[x : x + K.LOW]
                        at = np.minimum(np.searchsorted(sorted_, part), len(sorted_) - 1)
                        for w in np.flatnonzero((sorted_[at] == part) & (doc[x : x + len(part)] == doc[x + k - 1 : x + k - 1 + len(part)])).tolist():
                            raw = raw or buf.tobytes()
                            g, w = int(at[w]), x + w
                            own = b" ".join([raw[p:q] for p, q in zip(a[w : w + k].tolist(), b[w : w + k].tolist())])
                            while g < len(sorted_) and sorted_[g] == rolled[w]:
                                if words[starts[g] : ends[g]] == own:
                                    hit[w : w + k] = True
                                    their = slice(first[g], last[g])
                                    items.setdefault(int(doc[w]), set()).update(ids[their][named[their]].tolist())
                                    break
                                g += 1
                n = np.bincount(doc, minlength=j - i)
                n_hit = np.bincount(doc[hit], minlength=j - i)
                cut = np.concatenate([[0], np.cumsum(n)])
                spans = []
                for d in range(j - i):
                    if not n_hit[d]:
                        spans.append([])
                        continue
                    edge = np.diff(hit[cut[d] : cut[d + 1]].astype(np.int8), prepend=0, append=0)
                    spans.append([{"a": x, "b": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                own = [sorted(items.get(d, ())) for d in range(j - i)]
                yield pa.record_batch(
                    [
                        keys.slice(i, j - i), tkeys.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                        pa.array(own, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    ],
                    names=["doc_id", "tkey", "n_words", "n_hit", "items", "spans"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, tkey (hash of the text), n_words, n_hit,
    items (ids with occurring windows) and spans (maximal runs of hit words, [a, b))."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text"))
    blocks = indexes(benchmark, window, most)
    one, two = next(blocks, build_index([])), next(blocks, None)
    base = d.mapInArrow(_scan(spark.sparkContext.broadcast(one)), _HITS)
    if two is None:
        return base
    base, hits = save(base, "hits"), []
    hits.append(base)
    for index in itertools.chain([two], blocks):
        shared = spark.sparkContext.broadcast(index)
        hits.append(save(d.mapInArrow(_scan(shared), _HITS).where("n_hit > 0"), "hits"))
        shared.destroy()
    hits = [x.where("n_hit > 0").select("doc_id", "tkey", "items", "spans").distinct() for x in hits]
    merged = hits[0]
    for x in hits[1:]:
        merged = merged.unionByName(x)
    merged = merged.groupBy("doc_id", "tkey").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    span = "array<struct<a:int,b:int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= s["a"]), grown).otherwise(F.concat(done, F.array(s)))

    merged = merged.withColumn("spans", F.aggregate("spans", F.array().cast(span), add))
    m = merged.select(F.col("doc_id").alias("i"), F.col("tkey").alias("k"), F.col("items").alias("its"), F.col("spans").alias("sps"))
    base = base.select("doc_id", "tkey", "n_words")
    return base.join(m, base["doc_id"].eqNullSafe(m["i"]) & (base["tkey"] == m["k"]), "left").select(
        "doc_id", "tkey", "n_words",
        F.coalesce(F.aggregate("sps", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("its", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("sps", F.array().cast(span)).alias("spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return r.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _clean(shared):
    scan = _scan(shared)

    def run(batches):
        for batch in batches:
            sub = pa.record_batch([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "tkey", "text"])
            hit = np.concatenate([x.column("n_hit").to_numpy() for x in scan([sub])] or [np.zeros(0, np.int64)])
            yield batch.filter(pa.array(hit == 0))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a benchmark window go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns."""
    spark = docs.sparkSession
    blocks = indexes(benchmark, window, most)
    one, two = next(blocks, build_index([])), next(blocks, None)
    clean = docs.mapInArrow(_clean(spark.sparkContext.broadcast(one)), docs.schema)
    for index in itertools.chain([two], blocks) if two else ():
        clean = save(clean, "clean").mapInArrow(_clean(spark.sparkContext.broadcast(index)), docs.schema)
    return clean


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (
    SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM b),
d AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (
    SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
m AS (SELECT d.doc_id, d.k, d.i, b.item_id FROM d JOIN b ON d.k = b.k AND d.w = b.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""
