"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a vector of transformed statistics (logs of sizes, log odds of shares).
Per class the mean and the covariance are summed up in parallel over all labelled training
rows; covariances are shrunk towards the pooled one and a multiple of the identity, factored once (Cholesky), and a
score is the logistic of the difference of Mahalanobis log densities plus log priors, divided
by the number of statistics' root as a temperature.

Defined cases: null and empty texts have the statistics of a text without words and are scored
like any other; documents without an id are scored and never trained on; rows of labels
with null quality or other values than 0 and 1 are ignored, repeated label rows count once,
conflicting ones not at all; extra columns are ignored. With fewer than two training rows of a class
every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_IDS, save, save_seen, table

FOLDS = 5
CUT = 0.3
#: Weights of the pooled covariance and of the mean variance in a class covariance.
POOLED, ROUND = 0.3, 0.05

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"#$%&*@^~", b"|<>{}[]\\/=_+`"], 1):
    _CLASS[list(_set)] = _i
_CLASS[0x80:0xC0] = 10
_CLASS[0xC0:] = 11
N_CLASSES = 12
N_STATS = 18


def _share(x, n):
    """Log odds of x out of n, smoothed."""
    return np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5) + 1e-3)


def statistics(parts: list[bytes]) -> np.ndarray:
    """One row of N_STATS transformed statistics for each text (at most 1,023 a call)."""
    n = len(parts)
    buf, starts = K.joined(parts)
    c = np.zeros(n * N_CLASSES)
    for i in range(0, len(buf), K.LOW):
        part = _CLASS[buf[i : i + K.LOW]]
        first = np.searchsorted(starts, i, side="right") - 1
        own = np.repeat(np.arange(n - first), np.diff(np.clip(starts[first:], i, i + len(part))))
        c[first * N_CLASSES :] += np.bincount(own * N_CLASSES + part, minlength=(n - first) * N_CLASSES)
    c = c.reshape(n, N_CLASSES)
    c[:, 5] -= 1  # the line feed put after each text
    chars = c.sum(axis=1) - c[:, 10]
    a, b = K.words(buf, K.SPACED)
    doc = K.owners(starts, a)
    h = K.spans(buf, a, b)
    words = np.bincount(doc, minlength=n).astype(float)
    length = np.bincount(doc, weights=b - a, minlength=n)
    squares = np.bincount(doc, weights=(b - a).astype(float) ** 2, minlength=n)
    same = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    again = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
    keys, times = np.unique((doc.astype(K.U) << K.U(54)) | (h >> K.U(10)), return_counts=True)
    owner = (keys >> K.U(54)).astype(np.int64)
    kinds = np.bincount(owner, minlength=n)
    entropy = np.bincount(owner, weights=times * np.log(times), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    pair = K.mix(h[:-1] ^ K.mix(h[1:], 3))[same] if len(h) > 1 else np.zeros(0, K.U)
    pairs = K.distinct((doc[1:][same].astype(K.U) << K.U(54)) | (pair >> K.U(10)))
    pair_kinds = np.bincount((pairs >> K.U(54)).astype(np.int64), minlength=n)
    short = np.bincount(doc[(b - a) <= 3], minlength=n)
    last = _CLASS[buf[b - 1]] if len(b) else np.zeros(0, np.int64)
    ended = np.bincount(doc[(last == 6)], minlength=n)
    marked = np.bincount(doc[(last == 8) | (last == 9)], minlength=n)
    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    line_doc = K.owners(starts, begins)
    lines = np.bincount(line_doc, minlength=n)
    line_kinds = np.bincount((K.distinct((line_doc.astype(K.U) << K.U(54)) | (K.spans(buf, begins, ends) >> K.U(10))) >> K.U(54)).astype(np.int64), minlength=n)
    w1 = words + 1
    mean = (length + 5) / w1
    letters = c[:, 1] + c[:, 2] + c[:, 11]
    return np.column_stack([
        np.log(w1), np.log(mean), np.log(squares / w1 + 1), _share(again, words), np.log((kinds + 1) / w1), np.log(w1) - entropy / w1,
        np.log((top + 1) / w1), np.log((pair_kinds + 1) / w1), _share(short, words), _share(ended, words), _share(marked, words),
        _share(c[:, 2], letters), _share(c[:, 3], chars), _share(c[:, 7], chars), _share(c[:, 8], chars), _share(c[:, 9] + c[:, 0], chars),
        np.log((lines + 1) / w1), _share(lines - line_kinds, lines),
    ])


_DDL = "doc_id long, x array<double>"


def _stats(batches):
    for batch in batches:
        texts = K.texts(batch.column("text"))
        for i, j in K.pieces([len(t) for t in texts]):
            x = statistics(texts[i:j])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), lists], names=["doc_id", "x"])


def _moments(batches):
    """Sums of 1, x and x x^T by class, as (class, place, value) rows."""
    total = np.zeros((2, 1 + N_STATS + N_STATS * N_STATS))
    for batch in batches:
        if not len(batch):
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, N_STATS)
        y = batch.column("y").to_numpy()
        for k in (0, 1):
            v = x[y == k]
            total[k] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
    k, at = np.nonzero(total)
    yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], names=["y", "place", "value"])


def train(moments: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> dict:
    """Means, Cholesky factors and constants of both classes from their summed moments."""
    n = moments[:, 0]
    if n.min() < 2:
        p = float(n[1] / n.sum()) if n.sum() else 0.5
        return {"constant": p}
    mean = moments[:, 1 : 1 + N_STATS] / n[:, None]
    cov = moments[:, 1 + N_STATS :].reshape(2, N_STATS, N_STATS) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    both = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    model = {"scale": scale, "mean": mean / scale, "factor": [], "constant": None, "bias": []}
    for k in (0, 1):
        c, p = cov[k] / np.outer(scale, scale), both / np.outer(scale, scale)
        c = (1 - pooled) * c + pooled * p
        c = (1 - round_) * c + round_ * (np.trace(c) / N_STATS) * np.eye(N_STATS) + 1e-9 * np.eye(N_STATS)
        f = np.linalg.cholesky(c)
        model["factor"].append(np.linalg.inv(f))
        model["bias"].append(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum())
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if model["constant"] is not None:
        return np.full(len(x), model["constant"])
    x = x / model["scale"]
    log = [model["bias"][k] - 0.5 * (((x - model["mean"][k]) @ model["factor"][k].T) ** 2).sum(axis=1) for k in (0, 1)]
    z = np.clip((log[1] - log[0]) / np.sqrt(N_STATS), -60, 60)
    return 1 / (1 + np.exp(-z))


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Learns from the rows whose id is in a training fold; only 2 x (1 + d + d^2) sums reach the driver."""
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("z"))
    y = y.where("y = z").select("doc_id", "y").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    sums = stats.join(y, "doc_id").select("x", "y").mapInArrow(_moments, "y int, place int, value double").groupBy("y", "place").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 1 + N_STATS + N_STATS * N_STATS))
    for r in sums.collect():
        total[r.y, r.place] = r.value
    return train(total)


def _scored(shared):
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, N_STATS) if len(batch) else np.zeros((0, N_STATS))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score(shared.value, x))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1: label 1 likelier) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = save(d.mapInArrow(_stats, _DDL), "statistics")
    model = spark.sparkContext.broadcast(fit(stats, labels))
    return stats.mapInArrow(_scored(model), "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return r.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _accepted(shared, cut):
    def run(batches):
        for batch in batches:
            texts = K.texts(batch.column("text"))
            ok = [score(shared.value, statistics(texts[i:j])) >= cut for i, j in K.pieces([len(t) for t in texts])]
            yield batch.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, bool)))

    return run


def keep_accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    ids, (n_ids,) = save_seen(labels.select(F.col("doc_id").alias("__id")).distinct(), "labelled", F.count(F.lit(1)))
    if n_ids <= BROADCAST_IDS:  # else both sides are shuffled
        ids = F.broadcast(ids)
    labelled = docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    model = fit(labelled.select("doc_id", "text").mapInArrow(_stats, _DDL), labels)
    return docs.mapInArrow(_accepted(spark.sparkContext.broadcast(model), CUT), docs.schema)
