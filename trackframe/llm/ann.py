"""Maximum inner product search with anisotropic four-bit product quantisation.

A quantiser splits vectors into pairs of coordinates with 16 centres each. It is fitted on
a bounded sample under the score-aware loss, which weighs the part of the residual parallel
to the vector ``eta`` times: centres solve the coupled weighted least squares, codes go down
by coordinate descent. All vectors are encoded; every query block scans every block of codes
through look-up tables, all vectors of the best ``rerank`` different codes of a block are scored
exactly in double precision on the originals, and the best of all blocks stay. Copies of a vector
are one place of that list, however many they are.

Vectors are dealt once to blocks of a size that only their number and length set, by a hash of their id, so equal vectors
spread and the rows found don't depend on partitions; a block is a row of arrays. Queries are dealt to blocks of
QUERIES too, and each is broadcast in turn (some MB) to a pass over the blocks of codes: no vector moves again. What is collected
is the sample (SAMPLE vectors about), and one block of queries at a time.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another
length than most take no part, nor do rows without an id; a query's own id is no candidate; of
repeated rows each candidate row counts, but a query asks once (rows of one id with different
vectors share its places); ties go to the smaller id; with no valid
vectors the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

SAMPLE = 8192
CENTRES = 16
THRESHOLD = 0.2
RERANK = 200
#: Vectors of a block (fewer if its vectors had over BLOCK_BYTES), and queries of one.
BLOCK, BLOCK_BYTES, QUERIES = 16384, 16 << 20, 4096
#: Query blocks whose results are written together.
TOGETHER = 16


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel part for inner products over threshold * norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """centres: (parts, CENTRES, 2); vectors of odd length are padded by a zero."""

    def __init__(self, centres: np.ndarray, weight: float):
        self.centres, self.weight = centres, weight

    def split(self, x: np.ndarray) -> np.ndarray:
        parts = len(self.centres)
        if x.shape[1] < 2 * parts:
            x = np.pad(x, ((0, 0), (0, 2 * parts - x.shape[1])))
        return x.reshape(len(x), parts, 2)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, parts) by coordinate descent on the anisotropic loss."""
        v = self.split(x)
        unit = v / np.sqrt((v**2).sum(axis=(1, 2)))[:, None, None]
        loss = ((v[:, :, None, :] - self.centres[None]) ** 2).sum(axis=3)  # squared residual of each choice
        along = ((v[:, :, None, :] - self.centres[None]) * unit[:, :, None, :]).sum(axis=3)  # its parallel part
        codes = loss.argmin(axis=2)
        n = np.arange(len(v))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for p in range(len(self.centres)):
                rest = total - along[n, p, codes[:, p]]
                best = (loss[:, p] + (self.weight - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(axis=1)
                codes[:, p] = best
                total = rest + along[n, p, best]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Look-up tables (queries, ceil(parts / 2), 256): two four-bit codes a byte."""
        t = np.einsum("qpd,pcd->qpc", self.split(q), self.centres).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], axis=1)
        return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, CENTRES * CENTRES)


def packed(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return (codes[:, 0::2] + CENTRES * codes[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, rounds: int = 4, seed: int = 1) -> Quantiser:
    """Alternates codes and centres; centres solve (D + (eta - 1) V'V) c = eta Z'x."""
    dim = x.shape[1]
    parts = -(-dim // 2)
    weight = eta(dim)
    rng = np.random.default_rng(seed)
    quantiser = Quantiser(np.zeros((parts, CENTRES, 2)), weight)
    v = quantiser.split(x)
    for p in range(parts):  # plain k-means of each pair first
        c = v[rng.choice(len(v), CENTRES, replace=len(v) < CENTRES), p]
        for _ in range(6):
            near = ((v[:, p, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=CENTRES)
            for d in (0, 1):
                c[:, d] = np.where(n > 0, np.bincount(near, weights=v[:, p, d], minlength=CENTRES) / np.maximum(n, 1), c[:, d])
        quantiser.centres[p] = c
    unit = v / np.sqrt((v**2).sum(axis=(1, 2)))[:, None, None]
    size = parts * CENTRES * 2
    for _ in range(rounds):
        a, b = np.zeros((size, size)), np.zeros(size)
        for at in range(0, len(x), 1024):
            codes = quantiser.encode(x[at : at + 1024])
            slot = ((np.arange(parts)[None] * CENTRES + codes)[:, :, None] * 2 + np.arange(2)).reshape(len(codes), -1)
            m = np.zeros((len(codes), size))
            np.put_along_axis(m, slot, unit[at : at + 1024].reshape(len(codes), -1), axis=1)
            a += (weight - 1) * (m.T @ m)
            a[np.arange(size), np.arange(size)] += np.bincount(slot.ravel(), minlength=size)
            b += weight * np.bincount(slot.ravel(), weights=v[at : at + 1024].ravel(), minlength=size)
        ridge = 1e-6 * len(x) / CENTRES
        a[np.arange(size), np.arange(size)] += ridge
        b += ridge * quantiser.centres.ravel()
        quantiser.centres = np.linalg.solve(a, b).reshape(parts, CENTRES, 2)
    return quantiser


def valid(vectors: DataFrame) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("id is not null and v is not null").where(good & F.exists("v", lambda x: x != 0))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == top[0]["d"]) if top else v.limit(0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_PACKED = "block long, ids binary, vectors binary, codes binary"


def _packed(shared):
    """One block's rows (block, id, v) to a row of arrays, with the codes if there is a quantiser."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = _matrix(t.column("v").chunk(0)) + 0.0  # no -0.0
        codes = b"" if shared is None else np.concatenate([packed(shared.value.encode(x[i : i + 4096])) for i in range(0, len(x), 4096)]).tobytes()
        return pa.table({"block": t.column("block").slice(0, 1), "ids": [t.column("id").to_numpy().tobytes()], "vectors": [x.tobytes()], "codes": [codes]})

    return run


def _in_blocks(v: DataFrame, n: int, shared, name: str) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, n)))
    return save(v.select(block.alias("block"), "id", "v").groupBy("block").applyInArrow(_packed(shared), _PACKED), name)


_FOUND = "query_id long, vec_id long, score double"


def _numbers(keys: list[bytes]) -> np.ndarray:
    """Numbers from 0 in order of first appearance; equal keys share one."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(x, len(seen)) for x in keys], dtype=np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] places), then those of starts[1] and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal numbers (0 or more)."""
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    return starts, np.diff(starts, append=len(x))


def _nearest(quantiser: Quantiser, qi, qv, di, dv, codes, k: int, rerank: int):
    """For each query the best k rows of one block: (query ids, row ids, scores)."""
    keys = [c.tobytes() for c in codes]
    code, vec = _numbers(keys), _numbers([c + x.tobytes() for c, x in zip(keys, dv)])
    order = np.lexsort((di, vec, code))
    di, code, vec = di[order], code[order], vec[order]
    # copies are one vector, and vectors of one code are scored once: codes hold vectors, vectors hold rows
    v_at, v_rows = _runs(vec)
    c_at, c_vecs = _runs(code[v_at])
    distinct = dv[order[v_at]]
    codes = codes[order[v_at[c_at]]].T.copy()
    v_of, c_of = np.repeat(np.arange(len(v_at)), v_rows), np.repeat(np.arange(len(c_at)), c_vecs)
    # so many rows of a vector hold k besides those of any one id
    same = np.flatnonzero(np.concatenate([[True], (v_of[1:] != v_of[:-1]) | (di[1:] != di[:-1])]))
    v_most = np.minimum(v_rows, k + np.diff(same, append=len(di)).max())
    by_id = np.argsort(di, kind="stable")
    n = min(rerank, len(c_at))
    out = []
    for at in range(0, len(qi), 64):
        tables = quantiser.tables(qv[at : at + 64])
        s = np.zeros((len(tables), len(c_at)), dtype=np.float32)
        for j in range(len(codes)):
            s += np.take(tables[:, j], codes[j], axis=1)
        own = []  # vectors that only the query itself has
        for row in range(len(s)):
            lo, hi = np.searchsorted(di, qi[at + row], sorter=by_id), np.searchsorted(di, qi[at + row], side="right", sorter=by_id)
            mine, rows = np.unique(v_of[by_id[lo:hi]], return_counts=True)
            mine = mine[rows == v_rows[mine]]
            own.append(mine)
            if len(mine):
                held, vecs = np.unique(c_of[mine], return_counts=True)
                s[row, held[vecs == c_vecs[held]]] = -np.inf
        border = np.partition(s, len(c_at) - n, axis=1)[:, len(c_at) - n]
        for row in range(len(s)):
            near = np.flatnonzero((s[row] >= border[row]) & (s[row] > -np.inf))
            places = _ranges(c_at[near], c_vecs[near])
            if len(own[row]):
                places = places[~np.isin(places, own[row])]
            exact = distinct[places] @ qv[at + row]
            if len(exact) > k:
                good = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
                places, exact = places[good], exact[good]
            rows, score = _ranges(v_at[places], v_most[places]), np.repeat(exact, v_most[places])
            ids = di[rows]
            ids, score = ids[ids != qi[at + row]], score[ids != qi[at + row]]
            best = np.lexsort((ids, -score))[:k]
            out.append((np.full(len(best), qi[at + row]), ids[best], score[best]))
    return [np.concatenate(x) for x in zip(*out)]


def _best(q, ids, score, k: int):
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < k
    return q[keep], ids[keep], score[keep]


def _scanned(shared, asked, k: int, rerank: int):
    """Blocks to the best k rows of a task's blocks for each query."""

    def run(batches):
        qi, qv = asked.value
        found, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                di = np.frombuffer(r["ids"], dtype=np.int64)
                dv, codes = np.frombuffer(r["vectors"]).reshape(len(di), -1), np.frombuffer(r["codes"], dtype=np.uint8).reshape(len(di), -1)
                found.append(_nearest(shared.value, qi, qv, di, dv, codes, k, rerank))
                size += len(found[-1][0])
                if size > 4 * k * len(qi):
                    found = [_best(*(np.concatenate(x) for x in zip(*found)), k)]
                    size = len(found[0][0])
        if found:
            q, ids, score = _best(*(np.concatenate(x) for x in zip(*found)), k)
            yield pa.record_batch([pa.array(q), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors (vec_id,
    embedding) for which ``queries`` (a condition on the column id) holds."""
    spark = vectors.sparkSession
    v = valid(vectors)
    n, nq, dim = v.agg(F.count("*"), F.count_if(queries), F.max(F.size("v"))).first()
    if not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / max(n, 1))
    drawn = v.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = np.array([r.v for r in drawn.orderBy("id", "v").limit(2 * sample).collect()], dtype=np.float64)  # in order: the fit is the same for any partitions
    if not len(drawn):
        drawn = np.array([r.v for r in v.orderBy("id", "v").limit(1).collect()], dtype=np.float64)
    shared = spark.sparkContext.broadcast(fit(drawn))
    data = _in_blocks(v, -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))), shared, "vectors")
    blocks = _in_blocks(v.where(queries).distinct(), -(-nq // QUERIES), None, "queries").toLocalIterator()
    found = []
    while True:
        held = []
        for r in itertools.islice(blocks, TOGETHER):
            ids = np.frombuffer(r.ids, dtype=np.int64)
            asked = spark.sparkContext.broadcast((ids, np.frombuffer(r.vectors).reshape(len(ids), -1)))
            held.append(data.mapInArrow(_scanned(shared, asked, k, rerank), _FOUND))
        if not held:
            break
        found.append(functools.reduce(DataFrame.unionByName, held))
        if len(held) == TOGETHER:
            found[-1] = save(found[-1], "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = functools.reduce(DataFrame.unionByName, found)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
