"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half the hashes (XXH64, seed 42) of its word shingles, repeats included, have it.
Documents whose fingerprints differ in ``distance`` bits or fewer are linked; classes are the connected components.

The 64 bits are cut into PARTS parts. Bits that go together over all fingerprints share a part, so that the parts tell more apart.
If thresholds t of the parts (-1: not looked at) add up to distance - PARTS + 1, two fingerprints within the distance differ in
t or fewer bits in one part at least. Each fingerprint gets thresholds of its own, by dynamic programming over its parts on the estimated number of
candidates (counts of part values over all fingerprints, in BINS hashed bins a part: never too low) and of probes. It then
probes, in each part with t >= 0, all values within t bits of its own, and candidates are verified on all 64 bits inside of
that join, which has verified links as its only rows. Where even the best thresholds expect more candidates than there are
fingerprints within the distance, those are looked up themselves (all 64 bits as one part); so the work is bounded by a number a fingerprint,
whatever share of all rows has one value in a part.

Equal fingerprints are one node, so copies cost nothing. What the driver sees is bounded: sums by pairs of bits and by bins.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text with fewer words than a shingle
has one shingle, its whole sequence; rows with equal doc_id are separate rows of the same name; rows without a doc_id link others, but
name a class only if no row with an id is in it (component null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_IDS, components, save, save_seen, table

BITS, PARTS, DISTANCE, SHINGLE = 64, 3, 2, 3
BINS = 1 << 16
#: What a probe costs, in verified candidates.
PROBE = 4
#: Shingles hashed together, and fingerprints dealt with at once.
TOGETHER, ROWS = 1 << 16, 8192
_LOWER = bytes(K.LOWER)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.translate(_LOWER).split()  # at \x20 and \x09-\x0D
    if not words:
        return 0
    text, n = b" ".join(words), len(words)
    del words
    space = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = np.append(0, space + 1), np.append(space, len(text))
    if n >= k:
        starts, ends = starts[: n - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(starts), TOGETHER):
        h = [hashed(text[a:b], 42) for a, b in zip(starts[i : i + TOGETHER].tolist(), ends[i : i + TOGETHER].tolist())]
        count += _bits(np.array(h, dtype=K.U)).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<i8")[0])


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, lowest bit first."""
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")


def _fingerprinted(k: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t, k) for t in K.texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of each row of docs (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_fingerprinted(shingle), "doc_id long, fp long")


def _pair_sums(batches):
    """Over a task's fingerprints: how many have both bits i and j set (slot 64 * i + j)."""
    both = np.zeros((BITS, BITS))
    for batch in batches:
        x = _bits(batch.column("fp").to_numpy().view(K.U)).astype(np.float32)
        both += x.T @ x
    yield pa.record_batch([pa.array(np.arange(BITS * BITS)), pa.array(both.ravel().astype(np.int64))], names=["slot", "s"])


def grouped_bits(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """The bits of each part, those that go together in one: a part starts from the free bit that goes best with the other free ones
    and takes the one that goes best with the part, until it is full."""
    mean = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        own = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        while len(own) < size:
            rest = [b for b in free if b not in own]
            own.append(max(rest, key=lambda b: (tie[b, own].sum(), -b)))
        free = [b for b in free if b not in own]
        out.append(sorted(own))
    return out


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part as one number."""
    x, out = fp.view(K.U), np.zeros(len(fp), dtype=K.U)
    for i, b in enumerate(bits):
        out |= (x >> K.U(b) & K.U(1)) << K.U(i)
    return out


def ball(width: int, t: int) -> np.ndarray:
    """Masks of at most t of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(t + 1) for c in itertools.combinations(range(width), r)], dtype=K.U)


def _bin(values: np.ndarray) -> np.ndarray:
    return (K.mix(values) >> K.U(48)).astype(np.int64)


def _bin_counts(groups: list[list[int]]):
    def run(batches):
        counts = np.zeros((len(groups), BINS), dtype=np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for p, bits in enumerate(groups):
                counts[p] += np.bincount(_bin(part_values(fp, bits)), minlength=BINS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts.ravel()[used])], names=["slot", "s"])

    return run


def _summed(df: DataFrame, function, size: int) -> np.ndarray:
    """Sums by slot over all tasks; ``size`` slots at most."""
    out = np.zeros(size, dtype=np.int64)
    for r in df.mapInArrow(function, "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s")).collect():
        out[r["slot"]] = r["s"]
    return out


def allocated(values: list[np.ndarray], groups: list[list[int]], counts: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds (fingerprints x parts); -2 everywhere where the whole fingerprint is to be looked up.

    Where thresholds of 0 in all parts do and cost no more than the probes of any threshold of 1, they are the best ones."""
    out = np.zeros((len(values[0]), len(groups)), dtype=np.int8)
    if len(groups) == distance + 1:
        plain = sum(counts[p][_bin(v)] + PROBE for p, v in enumerate(values))
        rest = np.flatnonzero(plain > PROBE * min(1 + len(bits) for bits in groups))
    else:
        rest = np.arange(len(out))
    if len(rest):
        out[rest] = _best([v[rest] for v in values], groups, counts, distance)
    return out


def _best(values: list[np.ndarray], groups: list[list[int]], counts: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds by dynamic programming over the parts.

    After part p, best[s] is the least cost of parts 0 to p with thresholds that add up to s - (p + 1)."""
    n, m = len(values[0]), len(groups)
    total = distance + 1  # thresholds above -1, added up over all parts
    best, chosen = [np.zeros(n)] + [np.full(n, np.inf)] * total, []
    for p, bits in enumerate(groups):
        cost = [np.zeros(n)]
        for t in range(distance + 1):
            masks = ball(len(bits), t)
            found = sum(counts[p][_bin(values[p] ^ x)] for x in masks)
            cost.append(found + float(PROBE * len(masks)))
        now, picks = [], []
        for s in range(total + 1):
            options = np.stack([best[s - x] + cost[x] for x in range(min(s, distance + 1) + 1)])
            pick = options.argmin(axis=0)
            picks.append(pick)
            now.append(np.take_along_axis(options, pick[None], axis=0)[0])
        best = now
        chosen.append(picks)
    out, s = np.zeros((n, m), dtype=np.int8), np.full(n, total)
    for p in reversed(range(m)):
        pick = np.stack(chosen[p])[s, np.arange(n)]
        out[:, p] = pick - 1
        s = s - pick
    out[best[total] > PROBE * len(ball(BITS, distance))] = -2
    return out


def _probing(groups: list[list[int]], shared, distance: int):
    """Rows (part, key, fp, probe): each fingerprint's own part values, and the values it looks for. Part -1 is the whole fingerprint."""

    def rows(part, key, fp, probe):
        n = len(key)
        return pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(key.view(np.int64)), pa.array(fp), pa.array(np.full(n, probe))], names=["part", "key", "fp", "probe"])

    def run(batches):
        counts = shared.value.reshape(len(groups), BINS)
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for i in range(0, len(every), ROWS):
                fp = every[i : i + ROWS]
                values = [part_values(fp, bits) for bits in groups]
                t = allocated(values, groups, counts, distance)
                for p, v in enumerate(values):
                    yield rows(p, v, fp, False)
                    for r in range(distance + 1):
                        own = np.flatnonzero(t[:, p] == r)
                        masks = ball(len(groups[p]), r)
                        step = max(1, (1 << 18) // len(masks))
                        for j in range(0, len(own), step):
                            at = own[j : j + step]
                            yield rows(p, (v[at][:, None] ^ masks).ravel(), np.repeat(fp[at], len(masks)), True)
                whole, masks = np.flatnonzero(t[:, 0] == -2), ball(BITS, distance)[1:]
                for j in range(0, len(whole), 128):
                    x = fp[whole[j : j + 128]]
                    yield rows(-1, (x.view(K.U)[:, None] ^ masks).ravel(), np.repeat(x, len(masks)), True)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """Pairs a < b of the different fingerprints (a table that is read several times) that differ in ``distance`` bits or fewer; pairs may repeat."""
    spark = fps.sparkSession
    both = _summed(fps, _pair_sums, BITS * BITS).reshape(BITS, BITS)
    groups = grouped_bits(both, fps.count(), parts)
    shared = spark.sparkContext.broadcast(_summed(fps, _bin_counts(groups), len(groups) * BINS))
    dealt, (n_whole,) = save_seen(fps.mapInArrow(_probing(groups, shared, distance), "part int, key long, fp long, probe boolean"), "probes", F.count_if(F.col("part") == -1))
    index = dealt.where("not probe").select("part", "key", F.col("fp").alias("b"))
    probes = dealt.where("probe").select("part", "key", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = probes.where("part >= 0").alias("p").join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    if n_whole:
        known = fps.select(F.col("fp").alias("b"))
        found = found.unionByName(probes.where("part = -1 and a < key").join(known, F.col("key") == F.col("b")).select("a", "b"))
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text)."""
    prints = save(fingerprints(docs, shingle), "fingerprints")
    fps = save(prints.groupBy("fp").agg(F.min("doc_id").alias("m")), "different")
    comp = components(links(fps.select("fp"), distance))
    comp, (n,) = save_seen(comp.select(F.col("id").alias("fp"), F.col("comp").alias("c")), "components", F.count(F.lit(1)))
    if n <= BROADCAST_IDS:  # else both sides are shuffled
        comp = F.broadcast(comp)
    named = save(fps.join(comp, "fp", "left").select("fp", "m", F.coalesce("c", "fp").alias("c")), "named")
    least = save(named.groupBy("c").agg(F.min("m").alias("component_id")), "least")
    named = save(named.join(least, "c").select("fp", "component_id"), "classes")  # written, so that Spark can split a skewed side of the join
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
