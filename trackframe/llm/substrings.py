"""Exact substring dedup: bytes covered by a 50-byte string that starts in a smaller document too.

Four passes, all in proportion to the text:

1. Documents are packed into chunks (a table of compressed rows). In each chunk every 50-byte
   window picks an anchor, the smallest-hash 24-byte string inside of it (leftmost on ties): equal
   windows pick equal anchors. Anchors that occur in one document only rule their windows out.
2. Neighbouring windows with one anchor form a segment (at most 76 bytes). Different segments
   with shared anchors go, with the smallest document that has them, to shards by anchor: so
   equal windows meet in one bucket, wherever they are.
3. A bucket is cut into shards of bounded size. A shard's text is its different segments one after the
   other; all suffixes get a suffix array by Larsson and Sadakane's refinement (ranks double what is
   known, up to 50 bytes; groups of one are left alone), neighbours their common prefixes by Kasai's
   walk, and runs of 50 bytes or more in common are equal windows. Shards of a bucket are merged by
   binary search for each other's different windows. The answer for a segment: which of its windows
   start in a smaller document.
4. Chunks join their answers and cover bytes.

A chunk sends any string once, so a passage that a third of all documents hold is sent once a
chunk, not once a document; and it sends one row to each part of the buckets, like a map task to each reducer.

Defined cases: null text is empty; texts under 50 bytes lose nothing; rows with equal ids are
never smaller than each other; rows without an id count as larger than any other; extra
columns are ignored. Anchors, and segments within a bucket, are compared by 64-bit hashes (an
anchor's collision only adds a candidate); windows by their bytes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import save, shuffle_width, table

LENGTH = 50
CHUNK = 2 << 20
#: Window starts hashed at once.
PART = 1 << 18
#: Bytes of one shard's text.
SHARD = 1 << 20
#: Bytes of text for a bucket.
BUCKET_TEXT = 2 << 20
LAST = (1 << 63) - 1


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, dtype=np.int64, count=1 + len(types), offset=0)[1:]
    at, out = 8 * (1 + len(types)), []
    for n, t in zip(sizes.tolist(), types):
        out.append(np.frombuffer(raw, dtype=t, count=n // np.dtype(t).itemsize, offset=at))
        at += n
    return out


def _chunker(batches):
    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def flush():
        nonlocal ids, texts, size, seq
        blob = _pack(
            np.array([LAST if x is None else x for x in ids], dtype=np.int64), np.array([x is None for x in ids]), np.array([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8)
        )
        row = pa.record_batch([pa.array([(part << 24) + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "size", "blob"])
        ids, texts, size, seq = [], [], 0, seq + 1
        return row

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), K.texts(batch.column(1))):
            ids.append(i)
            texts.append(t)
            size += len(t) + 16
            if size >= CHUNK:
                yield flush()
    if ids:
        yield flush()


class Runs:
    """The segments of one chunk, in order of (anchor, content).

    lo, hi: first and last window start of each segment's occurrence; doc: its document's
    place; fp: its anchor's hash; content: the hash of its bytes.
    """

    def __init__(self, blob: bytes, length: int):
        self.ids, self.null, self.sizes, text = _unpack(blob, np.int64, bool, np.int64, np.uint8)
        self.text = text
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        k = length // 2 - 1
        parts = []
        can = np.zeros(len(text) + 1, dtype=np.int8)  # window starts
        long = self.sizes >= length
        np.add.at(can, self.starts[:-1][long], 1)
        np.add.at(can, self.starts[1:][long] - length + 1, -1)
        can = np.cumsum(can, dtype=np.int8).astype(bool)
        for x in range(0, max(0, len(text) - length + 1), PART):
            part = self._part(text[x : x + PART + length - 1], can[x : x + PART], k, length)
            parts.append([x + part[0], x + part[1], *part[2:]])
        if parts:
            lo, hi, fp, content = (np.concatenate(p) for p in zip(*parts))
        else:
            lo = hi = np.zeros(0, np.int64)
            fp = content = np.zeros(0, K.U)
        order = np.lexsort((content, fp))
        self.lo, self.hi, self.fp, self.content = lo[order], hi[order], fp[order], content[order]
        self.doc = np.searchsorted(self.starts, self.lo, side="right") - 1
        self.head = np.ones(len(self.fp), dtype=bool)  # first of each anchor
        self.head[1:] = self.fp[1:] != self.fp[:-1]

    @staticmethod
    def _part(buf, can, k, length):
        s = K.prefix(buf)
        h = K.windows(s, k)
        v = (h & ~K.U((1 << 24) - 1)) | np.arange(len(h), dtype=K.U)
        width, span = 1, length - k + 1
        while 2 * width <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if span > width:
            v = np.minimum(v[: -(span - width)], v[span - width :])
        at = np.flatnonzero(can[: len(v)])
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, K.U), np.zeros(0, K.U)
        anchor = (v[at] & K.U((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
        # anchors are minima, so their hashes are small: mixed again, they spread over all buckets
        return lo, hi, K.mix(h[anchor[first]], 7), K.span(s, lo, hi + length)

    def anchors(self):
        """Hashes of the chunk's different anchors, and which of them two documents here hold."""
        first = np.flatnonzero(self.head)
        if not len(first):
            return self.fp, np.zeros(0, dtype=bool)
        ids = self.ids[self.doc]
        return self.fp[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def segments(self, shared: np.ndarray):
        """For occurrences with shared anchors: their places, the number of their different
        segment, and of each different segment the first occurrence and the smallest id."""
        at = np.flatnonzero(shared[np.cumsum(self.head) - 1]) if len(self.fp) else np.zeros(0, np.int64)
        fp, content = self.fp[at], self.content[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (fp[1:] != fp[:-1]) | (content[1:] != content[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.doc[at]], first) if len(first) else np.zeros(0, np.int64)
        return at, np.cumsum(new) - 1, at[first], least


def _bucket(fp: np.ndarray, n: int) -> np.ndarray:
    return ((fp >> K.U(32)) * K.U(n) >> K.U(32)).astype(np.int64)


_SENT = "part int, chunk long, blob binary"


def _sent(rows):
    b, c, x = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(x, pa.binary())], names=["part", "chunk", "blob"])


def _by_bucket(fp, n_buckets):
    cut = np.searchsorted(_bucket(fp, n_buckets), np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, slice(cut[b], cut[b + 1])


def _bundles(blobs, sub: int):
    """(bucket, blob) in order of buckets to (part, bundle): one row a part holds the blobs of its ``sub`` buckets."""
    for part, own in itertools.groupby(blobs, key=lambda x: x[0] // sub):
        own = list(own)
        head = np.array([len(own), *[b for b, _ in own], *[len(x) for _, x in own]], dtype=np.int64)
        yield part, head.tobytes() + b"".join(x for _, x in own)


def _opened(bundle: bytes) -> dict[int, bytes]:
    n = int(np.frombuffer(bundle, dtype=np.int64, count=1)[0])
    head = np.frombuffer(bundle, dtype=np.int64, count=2 * n, offset=8)
    ends = 8 * (1 + 2 * n) + np.cumsum(head[n:])
    return {int(b): bundle[e - s : e] for b, s, e in zip(head[:n], head[n:], ends)}


def _send_anchors(n_buckets: int, sub: int, length: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                fp, multi = Runs(blob.as_py(), length).anchors()
                yield _sent([(p, chunk, x) for p, x in _bundles(((b, _pack(fp[sl], multi[sl])) for b, sl in _by_bucket(fp, n_buckets)), sub)])

    return run


def _by_part(answer):
    """Rows sorted by part to answers: of each bucket all chunks' blobs are answered together, and a chunk gets its answers to a
    part as one row."""

    def part(now, rows):
        got = [(c, _opened(x)) for c, x in rows]
        out: dict[int, list] = {}
        for b in sorted({b for _, held in got for b in held}):
            own = [(c, held[b]) for c, held in got if b in held]
            for c, x in zip([c for c, _ in own], answer([x for _, x in own])):
                out.setdefault(c, []).append((b, x))
        return _sent([(now, c, next(_bundles(blobs, 1 << 60))[1]) for c, blobs in out.items()])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for p, c, x in zip(*(batch.column(n).to_pylist() for n in ("part", "chunk", "blob"))):
                if p != now and rows:
                    yield part(now, rows)
                    rows = []
                now = p
                rows.append((c, x))
        if rows:
            yield part(now, rows)

    return run


def _answer_anchors(blobs):
    parts = [_unpack(x, K.U, bool) for x in blobs]
    fp = np.concatenate([p[0] for p in parts])
    shared = np.concatenate([p[1] for p in parts])
    order = np.argsort(fp, kind="stable")
    f = fp[order]
    same = f[1:] == f[:-1]
    both = np.zeros(len(f), dtype=bool)
    both[1:] |= same
    both[:-1] |= same
    shared = shared.copy()
    shared[order] |= both
    cut = np.cumsum([0] + [len(p[0]) for p in parts])
    return [np.packbits(shared[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])]


def _known(answers) -> dict[int, bytes]:
    return {b: x for a in answers or () for b, x in _opened(a["blob"]).items()}


def _shared_anchors(runs: Runs, answers: list[dict], n_buckets: int) -> np.ndarray:
    fp, _ = runs.anchors()
    shared = np.zeros(len(fp), dtype=bool)
    known = _known(answers)
    for b, sl in _by_bucket(fp, n_buckets):
        shared[sl] = np.unpackbits(np.frombuffer(known[b], dtype=np.uint8), count=sl.stop - sl.start).astype(bool)
    return shared


def _gather(text: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return text[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _send_segments(n_buckets: int, sub: int, length: int):
    def run(batches):
        for batch in batches:
            for chunk, blob, answers in zip(batch.column("chunk").to_pylist(), batch.column("blob"), batch.column("answers")):
                r = Runs(blob.as_py(), length)
                _, _, first, least = r.segments(_shared_anchors(r, answers.as_py(), n_buckets))
                size = r.hi[first] - r.lo[first] + length
                blobs = (
                    (b, _pack(size[sl].astype(np.uint8 if length < 128 else np.int32), least[sl], _gather(r.text, r.lo[first[sl]], size[sl])))
                    for b, sl in _by_bucket(r.fp[first], n_buckets)
                )
                yield _sent([(p, chunk, x) for p, x in _bundles(blobs, sub)])

    return run


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of text in order of their first ``length`` bytes (eight or more), by Larsson and Sadakane's refinement.

    Suffixes start in order of their first eight bytes. A group of suffixes that are equal so far has its first place as rank;
    groups are sorted by the ranks of the suffixes h bytes on, which doubles what is known of all of them, until
    ``length`` bytes are; groups of one are left alone. Past its end the text is taken for zeros."""
    n = len(text)
    padded = np.append(text, np.zeros(8, dtype=np.uint8))
    key = sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(K.U)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + length, dtype=np.int32)  # past the end: below all others
    h = 8
    while True:
        first = np.flatnonzero(head)
        size = np.diff(first, append=n)
        rank[order] = np.repeat(first + 1, size)
        wide = np.repeat(size > 1, size)
        if h >= length or not wide.any():
            return order
        step = min(h, length - h)
        at = np.flatnonzero(wide)
        own = order[at]
        key = (rank[own].astype(K.U) << K.U(32)) | rank[own + step].astype(K.U)
        sub = np.argsort(key, kind="stable")
        order[at], key = own[sub], key[sub]
        head[at[1:]] = key[1:] != key[:-1]
        head[at[0]] = True
        h += step


#: Stretches of the text that are walked side by side.
LANES = 8192


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each suffix of the order has in common with the one before it, up to ``most``.

    Kasai's walk: along the text a suffix has at least one byte less in common with its neighbour than the suffix one byte before
    had with its own. LANES stretches of the text are walked at once, each with its own count."""
    n = len(order)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    words = sliding_window_view(np.append(text, np.zeros(most + 8, dtype=np.uint8)), 8)
    stride = -(-n // LANES)
    start = np.arange(0, n, max(1, stride))
    known = np.zeros(len(start), dtype=np.int64)
    found = np.zeros(n, dtype=np.int32)
    for i in range(stride):
        p = start + i
        p = p[p < n]  # only the last stretch is shorter
        q = before[p]
        left = np.where(q < 0, 0, np.minimum(n - np.maximum(p, q), most))
        known = np.minimum(known[: len(p)], left)
        live = np.flatnonzero(known < left)
        while len(live):  # eight bytes at once
            at = known[live]
            x = words[p[live] + at].view("<u8").ravel() ^ words[q[live] + at].view("<u8").ravel()
            same = np.where(x == 0, 8, np.log2((x & (~x + K.U(1))).astype(np.float64) + (x == 0)).astype(np.int64) >> 3)
            known[live] = np.minimum(at + same, left[live])
            live = live[(same == 8) & (known[live] < left[live])]
        found[p] = known
        # what was cut short says nothing about the next suffix
        known = np.where(known < left, np.maximum(known - 1, 0), 0)
    return found[order]


def _shards(sizes: np.ndarray):
    i = total = 0
    for j, n in enumerate(sizes.tolist()):
        if j > i and total + n > SHARD:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def least_documents(text: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Different segments, one after the other in text, with the smallest document that holds
    each: the smallest document that holds each of their windows, in order."""
    windows = size - length + 1
    begin = np.cumsum(size) - size
    done = []
    for i, j in _shards(size):
        own = text[begin[i] : begin[j - 1] + size[j - 1]]
        order = suffix_array(own, length)
        group = np.cumsum(common_prefixes(own, order, length) < length) - 1
        # the suffixes that are windows: those that don't begin in a segment's last bytes
        owner = np.repeat(np.arange(j - i), size[i:j])
        is_window = np.arange(len(own)) - (begin[i:j] - begin[i])[owner] < windows[i:j][owner]
        keep = is_window[order]
        order, group = order[keep], group[keep]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        docs = np.minimum.reduceat(least[i:j][owner[order]], first)
        number = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        place = np.cumsum(is_window) - 1
        done.append((sliding_window_view(own, length)[order[first]].copy().view(f"S{length}").ravel(), docs, number, place[order]))
    best = [d.copy() for _, d, *_ in done]
    for a in range(len(done)):  # merge the shards: each looks up its different windows in the others
        for b in range(len(done)):
            if a != b:
                at = np.minimum(np.searchsorted(done[b][0], done[a][0]), len(done[b][0]) - 1)
                hit = done[b][0][at] == done[a][0]
                best[a][hit] = np.minimum(best[a][hit], done[b][1][at[hit]])
    out = []
    for (_, _, number, place), docs in zip(done, best):
        part = np.empty(len(place), dtype=np.int64)
        part[place] = docs[number]
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _answer_segments(length: int):
    def answer(blobs):
        parts = [_unpack(x, np.uint8 if length < 128 else np.int32, np.int64, np.uint8) for x in blobs]
        size = np.concatenate([p[0] for p in parts]).astype(np.int64)
        least = np.concatenate([p[1] for p in parts])
        text = np.concatenate([p[2] for p in parts])
        begin = np.cumsum(size) - size
        content = K.spans(text, begin, begin + size)
        order = np.lexsort((least, content))
        c = content[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        first = order[new]
        number = np.empty(len(c), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        docs = least_documents(_gather(text, begin[first], size[first]), size[first], least[first], length)
        windows = size[first] - length + 1
        base = np.cumsum(windows) - windows
        # of each segment sent: a bit for each window that starts in a smaller document
        n = windows[number]
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        bit = docs[base[number[owner]] + place] < least[owner]
        ends = np.cumsum(n)
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        bounds = np.concatenate([[0], ends])[cut]
        return [np.packbits(bit[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])]

    return answer


_DONE = "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary, kept_sha256 string"


def _cover(n_buckets: int, length: int, keep_bytes: bool):
    def run(batches):
        for batch in batches:
            for blob, answers, found in zip(batch.column("blob"), batch.column("answers"), batch.column("found")):
                r = Runs(blob.as_py(), length)
                at, number, first, least = r.segments(_shared_anchors(r, answers.as_py(), n_buckets))
                n = (r.hi - r.lo + 1)[first]
                base = np.cumsum(n) - n
                bits = np.zeros(int(n.sum()), dtype=bool)
                known = _known(found.as_py())
                for b, sl in _by_bucket(r.fp[first], n_buckets):
                    x, y = int(base[sl.start]), int(base[sl.stop - 1] + n[sl.stop - 1])
                    bits[x:y] = np.unpackbits(np.frombuffer(known[b], dtype=np.uint8), count=y - x).astype(bool)
                # an occurrence in a larger document than the chunk's smallest loses all windows
                m = n[number]
                owner = np.repeat(np.arange(len(at)), m)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
                gone = bits[base[number[owner]] + place] | (r.ids[r.doc[at]] > least[number])[owner]
                start = r.lo[at][owner[gone]] + place[gone]
                edge = np.zeros(len(r.text) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                removed = np.cumsum(edge)[:-1] > 0
                rows = []
                for d in range(len(r.ids)):
                    x, y = r.starts[d], r.starts[d + 1]
                    own = removed[x:y]
                    if own.any():
                        turn = np.diff(own.astype(np.int8), prepend=0, append=0)
                        spans = [{"a": i, "b": j} for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())]
                        kept = r.text[x:y][~own].tobytes()
                    else:
                        spans, kept = [], r.text[x:y].tobytes()
                    rows.append((None if r.null[d] else int(r.ids[d]), int(y - x), spans, kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, spans (maximal removed runs
    [a, b) of bytes), kept (the bytes left, null unless keep_bytes) and their SHA-256."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = save(d.mapInArrow(_chunker, "chunk long, size long, blob binary"), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    width = shuffle_width(spark, total, 16 << 20)
    sub = max(1, -(-total // (width * BUCKET_TEXT)))
    n = width * sub

    def in_parts(df, answer):
        return df.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_by_part(answer), _SENT)

    def per_chunk(df, name):
        rows = df.groupBy("chunk").agg(F.collect_list(F.struct("blob")).alias(name))
        return rows.select(F.col("chunk").alias("c"), name)

    first = save(in_parts(chunks.mapInArrow(_send_anchors(n, sub, length), _SENT), _answer_anchors), "anchors")
    first = per_chunk(first, "answers")
    known = chunks.join(first, F.col("chunk") == F.col("c"), "left").select("chunk", "blob", "answers")
    second = save(in_parts(known.mapInArrow(_send_segments(n, sub, length), _SENT), _answer_segments(length)), "segments")
    second = per_chunk(second, "found")
    both = known.join(second, F.col("chunk") == F.col("c"), "left").select("blob", "answers", "found")
    return both.mapInArrow(_cover(n, length, keep_bytes), _DONE)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return r.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, b, substr(h, 2000 * b + 1, 2098) AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS b FROM d)),
w AS (SELECT doc_id, 1000 * b + i AS i, md5(substr(p, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, b, p, unnest(range(0, least(1000, length(p) // 2 - 49))) AS i FROM p)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
g AS (SELECT w.doc_id, i FROM w JOIN f USING (k) WHERE m < w.doc_id),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i + 50) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS gap FROM g),
r AS (SELECT doc_id, sum(gap) OVER (PARTITION BY doc_id ORDER BY i) AS n, i FROM s),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, n),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
k AS (
  SELECT o.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z,
    string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN z IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
