"""Product codes of vectors: integer codebooks trained over all rows, nearest entries by VA-file filtering.

Components become integers floor(256 * x), vectors are cut into PARTS equal parts, and each part of a vector gets the nearest entry of its
part's codebook. Entries are found as in a vector approximation file: every coordinate of an entry is quantised to a cell of a few bits; a
query part gets look-up tables of the smallest and the largest squared distance to each cell of each coordinate; summed along an entry's
cells they bound its distance from both sides, and only entries whose lower bound doesn't exceed the smallest upper bound are refined with
exact integer distances. So the result is that of a full search, ties to the lower index.

Training: the codebooks start as the parts of the ENTRIES smallest ids and are recomputed from all rows in each round: a task
sums its rows by part and entry, those sums are added by Spark, and the driver holds codebooks only (PARTS * ENTRIES entries). Rows never
move; the coded rows are written once, for the sums by label.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than most (ties: the
shortest); a length that PARTS doesn't divide is filled up by zeros at the end; with fewer rows than ENTRIES each row is an
entry; rows with equal ids give a row each, equal ids enter the first codebook in order of their vectors, rows without an id last; |x| beyond 2^19
counts as 2^19, so that squares stay whole numbers; no vector gives no row; extra columns are ignored; null labels are one label.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, save_seen, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LARGEST = 256, 1 << 27
#: Bits of a cell of the approximation.
BITS = 3
#: Vectors filtered at once.
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as whole numbers, rows x PARTS x part's length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), -1)
    if x.shape[1] % PARTS:
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    return x.reshape(len(x), PARTS, -1)


class Approximation:
    """The entries (entries x length) of one part and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, length = entries.shape
        cells = min(1 << bits, n)
        place = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0)
        self.cell = place * cells // n
        #: smallest and largest coordinate in each cell
        self.low = np.empty((length, cells), dtype=np.int64)
        self.high = np.empty((length, cells), dtype=np.int64)
        for d in range(length):
            for c in range(cells):
                own = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = own.min(), own.max()

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries."""
        below = self.low[None] - q[:, :, None]
        above = q[:, :, None] - self.high[None]
        near = np.maximum(np.maximum(below, above), 0) ** 2
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        shape = len(q), len(self.entries)
        lower, upper = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        for d in range(q.shape[1]):
            lower += near[:, d].take(self.cell[:, d], axis=1)
            upper += far[:, d].take(self.cell[:, d], axis=1)
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query (ties: the lowest) and its squared distance."""
        lower, upper = self.bounds(q)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # one entry a query at least
        exact = ((q[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        best = np.where(exact == least[row], entry, len(self.entries))
        return np.minimum.reduceat(best, first), least


def _assigned(books: np.ndarray):
    """books: parts x entries x length. A function of blocks of vectors to (codes, squared distances), rows x parts each."""
    parts = [Approximation(b) for b in books]

    def assign(x: np.ndarray):
        found = [parts[p].nearest(x[:, p]) for p in range(len(parts))]
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    return assign


def _blocks(batches):
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            own = batch.slice(i, BLOCK)
            yield own, _matrix(own.column("v"))


def _summing(books: np.ndarray):
    """The sums of a task's rows: (slot, s), slots numbering the components of all entries, then their counts."""

    def run(batches):
        assign = _assigned(books)
        parts, entries, length = books.shape
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, x in _blocks(batches):
            codes, _ = assign(x)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                own = codes[order, p]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums[p, own[first]] += np.add.reduceat(x[order, p], first, axis=0) if len(first) else 0
                counts[p] += np.bincount(own, minlength=entries)
        every = np.concatenate([sums.ravel(), counts.ravel()])
        used = np.flatnonzero(np.concatenate([np.repeat(counts.ravel() > 0, length), counts.ravel() > 0]))
        yield pa.record_batch([pa.array(used), pa.array(every[used])], names=["slot", "s"])

    return run


def _coding(books: np.ndarray):
    def run(batches):
        assign = _assigned(books)
        for own, x in _blocks(batches):
            codes, errors = assign(x)
            text = [r.astype(np.uint8).tobytes().hex() for r in codes]
            yield pa.record_batch(
                [own.column("vec_id"), own.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"]
            )

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == top[0]["d"]) if top else v.limit(0)


def train(v: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x length) of the rows of valid(); None without rows."""
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    books = _matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64()))).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = v.select("v").mapInArrow(_summing(books), "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s")).collect()
        every = np.zeros(books.size + books.shape[0] * books.shape[1], dtype=np.int64)
        for r in found:
            every[r["slot"]] = r["s"]
        sums, counts = every[: books.size].reshape(books.shape), every[books.size :].reshape(books.shape[:2])
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(v: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of the rows of valid()."""
    label = v.schema["label"].dataType.simpleString()
    return v.mapInArrow(_coding(books), f"vec_id long, label {label}, code string, error long")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256."""
    v = valid(vectors)
    books = train(v, entries, rounds)
    if books is None:
        none = v.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit("")})
    coded, _ = save_seen(encode(v, books), "codes", F.count(F.lit(1)))
    sums, (n,) = save_seen(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels", F.count(F.lit(1)))
    if n <= BROADCAST_IDS:  # else both sides are shuffled
        sums = F.broadcast(sums)
    both = coded.join(sums, coded["label"].eqNullSafe(sums["l"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = "arg_min(c.e, ({d}, c.e))".format(d="list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))")
    text = """
WITH k AS (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM k, range(16) t(p)),
first AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
c0 AS MATERIALIZED (SELECT p, e, v FROM first JOIN q USING (id)),
"""
    for r in range(ROUNDS):
        text += f"""a{r} AS MATERIALIZED (SELECT q.id, q.p, {near} AS e FROM q JOIN c{r} c ON c.p = q.p GROUP BY q.id, q.p),
x{r} AS (SELECT p, e, v, range(1, len(v) + 1) AS i FROM a{r} JOIN q USING (id, p)),
s{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, unnest(i) AS i FROM x{r}) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e),
"""
    return text + f"""last AS (SELECT q.id, q.p, {near} AS e FROM q JOIN c{ROUNDS} c ON c.p = q.p GROUP BY q.id, q.p),
d AS (
  SELECT l.id, string_agg(printf('%02x', l.e::INTEGER), '' ORDER BY l.p) AS code,
    sum(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))))::BIGINT AS error
  FROM last l JOIN q ON q.id = l.id AND q.p = l.p JOIN c{ROUNDS} c ON c.p = l.p AND c.e = l.e GROUP BY l.id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN d USING (id), h
"""


OP12_SQL = _sql()
