"""Periodic runs of words by the runs theorem.

A run is a maximal stretch of words with smallest period q that is at least ``times`` periods and ``least`` words long. By the
runs theorem each run has a Lyndon root that is the longest Lyndon word at its place, under the order of words or under the
reverse one; those are read off the inverse suffix array, as the distances to the next smaller and the next greater value. A root
is extended to the right by the common prefix of the two suffixes one period apart (common prefixes of neighbours in the suffix
array, minimum over a range by a sparse table of which one level is held at a time), and to the left by less than a period,
word by word. Roots with one end and period are one run.

Texts are taken in pieces of about 1 MB; suffixes are ordered within their own text, all texts of a piece at once. A text is worked on
whole by one task, in memory proportional to it; nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs; rows with equal doc_id give a row each; rows without a doc_id keep a
null id (and no words of theirs are replaced by ``planted``); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table

LEAST, TIMES = 24, 3
#: Rounds of jumps before the rest descends in a tree of minima.
JUMPS = 16
#: Stretches walked side by side, and places compared at once.
LANES, AT_ONCE = 2048, 1 << 20

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def next_smaller(x: np.ndarray) -> np.ndarray:
    """The first place after each one with a smaller value (len(x) if there is none).

    A place that isn't answered jumps on from its candidate to that one's candidate, all places at once; what JUMPS rounds
    leave open descends in a tree of minima."""
    n = len(x)
    x = np.append(x, np.iinfo(x.dtype).min)
    to = np.arange(1, n + 2, dtype=np.int32)
    to[n] = n
    open_ = np.flatnonzero(x[to[:n]] >= x[:n])
    for _ in range(JUMPS):
        if not len(open_):
            return to[:n]
        to[open_] = to[to[open_]]
        open_ = open_[x[to[open_]] >= x[open_]]
    levels = [x]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.append(low, low[-1])
        levels.append(np.minimum(low[::2], low[1::2]))
    base = np.cumsum([0] + [len(t) for t in levels])
    tree = np.concatenate(levels)
    node, level, want = to[open_].astype(np.int64), np.zeros(len(open_), np.int64), x[open_]
    climb = np.ones(len(open_), dtype=bool)
    live = np.arange(len(open_))
    while len(live):
        k, lv = node[live], level[live]
        hit = tree[base[lv] + k] < want[live]
        up = climb[live] & ~hit  # on to the next node, a level up where it begins a pair
        k = np.where(up, k + 1, k)
        rise = up & (k % 2 == 0)
        down = ~up
        climb[live[down]] = False
        done = down & (lv == 0) & hit
        # inside of a node that holds an answer: its left half first
        right = down & ~hit
        fall = down & hit & (lv > 0)
        k = np.where(rise, k // 2, np.where(fall, 2 * k, np.where(right, k + 1, k)))
        node[live], level[live] = k, lv + rise - fall
        live = live[~done]
    to[open_] = node
    return to[:n]


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of each suffix among all, ordered by text and then by words.

    ids: words as numbers from 1, each text followed by one 0; doc: its text, ascending. Suffixes are ordered by their text and as many words as
    a number holds, then groups that are equal so far by the ranks h words on, which doubles h; groups of one are left alone. A group of
    more than one lies in one text and h words or more from its end."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    top = max(1, int(doc[-1]).bit_length()) if n else 1
    h = max(1, min(4, (63 - top) // bits))
    key = doc.astype(np.int64)
    padded = np.append(ids, np.zeros(h, dtype=ids.dtype))
    for i in range(h):
        key <<= bits
        key |= padded[i : i + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    del key
    first = np.flatnonzero(head).astype(np.int32)
    size = np.diff(first, append=np.int32(n))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.repeat(first, size)
    at = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
    own = order[at]
    del order
    while len(at):
        key = (rank[own].astype(np.int64) << 32) | rank[own + h]
        sub = np.argsort(key, kind="stable").astype(np.int32)
        own, key = own[sub], key[sub]
        del sub
        head = np.ones(len(at), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        del key
        first = np.flatnonzero(head).astype(np.int32)
        size = np.diff(first, append=np.int32(len(at)))
        rank[own] = np.repeat(at[first], size)
        wide = np.repeat(size > 1, size)
        at, own = at[wide], own[wide]
        h *= 2
    return rank


def common_prefixes(ids: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words each suffix of the order has in common with the one before it (0 for the first of a text).

    Kasai's walk along the text, LANES stretches at once. A text ends in a 0 that nothing equals but its own place. start: where texts start."""
    n = len(ids)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    text = np.zeros(n, dtype=np.int32)
    text[start[1:]] = 1
    text = np.cumsum(text, dtype=np.int32)
    before[(before >= 0) & (text[before] != text)] = -1
    width = 512
    padded = np.append(ids, np.zeros(width + 1, dtype=ids.dtype))
    stride = -(-n // LANES)
    begin = np.arange(0, n, max(1, stride))
    known = np.zeros(len(begin), dtype=np.int64)
    found = np.zeros(n, dtype=np.int32)
    for i in range(stride):
        p = begin + i
        p = p[p < n]
        q = before[p].astype(np.int64)
        known = np.where(q < 0, 0, known[: len(p)])
        live = np.flatnonzero((q >= 0) & (ids[p] > 0))
        step = 1
        while len(live):
            a, b = p[live] + known[live], q[live] + known[live]
            if step == 1:
                same = ((padded[a] == padded[b]) & (padded[a] > 0)).astype(np.int64)
            else:  # long stretches in common are compared many words at once
                away = np.arange(step)
                left, right = padded[np.minimum(a[:, None] + away, n)], padded[np.minimum(b[:, None] + away, n)]
                differ = (left != right) | (left == 0)
                same = np.where(differ.any(axis=1), differ.argmax(axis=1), step)
            known[live] += same
            live = live[same == step]
            step = min(8 * step, width, max(1, AT_ONCE // max(1, len(live))))
        found[p] = known
        known = np.maximum(known - 1, 0)
    return found[order]


def range_minima(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of x[low:high] (low < high): a sparse table, one level at a time, that answers the ranges of its level."""
    level = (np.frexp((high - low).astype(np.float64))[1] - 1).astype(np.int8)
    out = np.zeros(len(low), dtype=x.dtype)
    t = x
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            t = np.minimum(t[: -(1 << k - 1)], t[1 << k - 1 :])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(t[low[own]], t[high[own] - (1 << k)])
    return out


def _leftward(ids: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """By how many words before ``at`` each period goes on; fewer than a period."""
    out = np.zeros(len(at), dtype=np.int64)
    i = 0
    ends = np.cumsum(period)
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, side="right")))
        p = period[i:j]
        first = np.cumsum(p) - p
        k = np.arange(p.sum()) - np.repeat(first, p)
        place = np.repeat(at[i:j], p) - 1 - k
        same = (place >= 0) & (ids[place] == ids[place + np.repeat(p, p)])
        out[i:j] = np.minimum.reduceat(np.where(same, np.repeat(p, p), k), first)
        i = j
    return out


def runs_of(ids: np.ndarray, start: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and periods of the runs of all texts, by place and period.

    ids: words as numbers from 1, a 0 after each text; start: where each text starts (every text has its 0). times is 3 or more."""
    none = np.zeros(0, np.int64)
    if len(ids) <= least:
        return none, none, none
    doc = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(start, append=len(ids)))
    rank = suffix_ranks(ids, doc)
    roots = []
    n = len(ids)
    for values in (rank, np.int32(n) - rank):
        to = next_smaller(values)
        i = np.flatnonzero((to < n) & (ids > 0)).astype(np.int32)
        j = to[i]
        del to
        # a run of three periods goes on for more than another one after its first root
        live = (ids[i] == ids[j]) & (doc[i] == doc[j])
        i, j = i[live], j[live]
        for back in (0, 1):  # one period on, or a word less, the words are the same too
            k = 2 * j - i - back
            live = k < n
            i, j, k = i[live], j[live], k[live]
            live = (ids[j - back] == ids[k]) & (doc[i] == doc[k])
            i, j = i[live], j[live]
        roots.append((i, j - i))
    at, period = (np.concatenate(x) for x in zip(*roots))
    if not len(at):
        return none, none, none
    # only texts that still have a root need common prefixes
    keep = np.zeros(len(start), dtype=bool)
    keep[doc[at]] = True
    mask = keep[doc]
    new = np.cumsum(mask, dtype=np.int32) - np.int32(1)
    sub, sub_doc, sub_rank = ids[mask], doc[mask], rank[mask]
    del rank
    sub_start = np.flatnonzero(np.diff(sub_doc, prepend=-1))
    order = np.argsort(sub_rank, kind="stable").astype(np.int32)
    place = np.empty(len(sub), dtype=np.int32)
    place[order] = np.arange(len(sub), dtype=np.int32)
    del sub_rank, sub_doc, doc
    lcp = common_prefixes(sub, order, sub_start)
    x = new[at]
    del new, at, order
    a, b = place[x], place[x + period]
    reach = range_minima(lcp, np.minimum(a, b) + 1, np.maximum(a, b) + 1)
    del a, b, place, lcp
    live = (reach > (times - 2) * period) & (reach + 2 * period > least)
    x, period, end = (v[live].astype(np.int64) for v in (x, period, x + period + reach))
    # roots of one run: the first one stays
    order = np.lexsort((x, end, period))
    x, period, end = x[order], period[order], end[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (period[1:] != period[:-1]) | (end[1:] != end[:-1])
    x, period, end = x[first], period[first], end[first]
    x = x - _leftward(sub, x, period)
    length = end - x
    live = length >= np.maximum(least, times * period)
    x, period, length = np.flatnonzero(mask)[x[live]], period[live], length[live]
    order = np.lexsort((period, x))
    return x[order], length[order], period[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words of this document from a on are replaced by repeats of p words (contract of the query)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def _first_words(buf: np.ndarray, a: np.ndarray, b: np.ndarray, pick: np.ndarray):
    """Chunks of bytes: the words ``pick`` joined by spaces."""
    step = 1 << 14
    for i in range(0, len(pick), step):
        w = pick[i : i + step]
        size = b[w] - a[w] + 1  # with the white space after the word
        end = np.cumsum(size)
        out = buf[np.repeat(a[w] - end + size, size) + np.arange(end[-1])]
        out[end - 1] = 32
        yield out[: end[-1] - 1].tobytes() if i + step >= len(pick) else out.tobytes()


def _piece(doc_ids: list, parts: list[bytes], least: int, times: int, plant, texts: bool) -> list[tuple]:
    buf, starts = K.joined(parts)
    a, b = K.words(buf, K.SPACED)
    count = np.diff(np.searchsorted(a, starts))
    first = np.cumsum(count) - count  # first word of each text
    # words as numbers; a 0 after each text
    ids = np.zeros(len(a) + len(parts), dtype=np.int32)
    number = np.unique(K.spans(buf, a, b), return_inverse=True)[1].astype(np.int32)
    number += 1
    ids[np.arange(len(a)) + np.repeat(np.arange(len(parts)), count)] = number
    del number
    start = first + np.arange(len(parts))
    changed = {}
    for d, n in enumerate(count.tolist()):
        found = plant(doc_ids[d], n) if plant else None
        if found:
            source = np.arange(n)
            source[found[0] :] = found[0] + np.arange(n - found[0]) % found[1]
            own = ids[start[d] : start[d] + n]
            own[:] = own[source]
            changed[d] = source
    at, length, period = runs_of(ids, start, least, times)
    owner = np.searchsorted(start, at, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(parts) + 1))
    gone = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(gone, at + period, 1)
    np.add.at(gone, at + length, -1)
    gone = np.cumsum(gone, dtype=np.int32)[:-1] > 0
    rows = []
    for d, n in enumerate(count.tolist()):
        i, j = cut[d], cut[d + 1]
        own = list(zip((at[i:j] - start[d]).tolist(), length[i:j].tolist(), period[i:j].tolist()))
        # exact comparison of length / period by cross products
        best = None
        for x in own:
            if best is None or (c := x[1] * best[2] - best[1] * x[2]) > 0 or c == 0 and (x[0], x[2]) < (best[0], best[2]):
                best = x
        pick = np.flatnonzero(~gone[start[d] : start[d] + n])
        if d in changed:
            pick = changed[d][pick]
        sha = hashlib.sha256()
        held = []
        for chunk in _first_words(buf, a, b, first[d] + pick):
            sha.update(chunk)
            if texts:
                held.append(chunk)
        listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        rows.append((doc_ids[d], n, len(own), *top, listed, sha.hexdigest(), own if texts else None, b"".join(held).decode() if texts else None))
    return rows


_NAMES = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]


def _finder(least: int, times: int, plant, texts: bool):
    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), K.texts(batch.column(1))
            for i, j in K.pieces([len(t) for t in parts]):
                columns = list(zip(*_piece(ids[i:j], parts[i:j], least, times, plant, texts)))
                if texts:
                    columns[9] = [[dict(zip(("start", "length", "period"), x)) for x in own] for own in columns[9]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant=None, texts: bool = True) -> DataFrame:
    """The runs of each row of docs (doc_id, text), of ``times`` (3 or more) periods and ``least`` words at least.

    Returns doc_id, n_words, n_runs; start, length, period and exponent_milli of the run of the greatest length / period (ties: smallest
    start, then period; null without runs); runs_sha256 of all runs, collapsed_sha256 of the collapsed text; with ``texts`` also the runs
    and the collapsed text itself: words inside of a run go after its first period, the others are joined by one space. ``plant(doc_id, n)`` may name (a, p): words from
    a on are then replaced by repeats of the p words at a first."""
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't found")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_finder(least, times, plant, texts), SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=planted, texts=False).drop("runs", "collapsed")


OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT k::BIGINT AS k, k::BIGINT AS v, 0 AS s FROM range(256) t(k)
  UNION ALL
  SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, s + 1 FROM step WHERE s < 8),
tab AS (SELECT list(v ORDER BY k) AS t FROM step WHERE s = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS h
  FROM documents CROSS JOIN tab),
p AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h, h // 10 AS g FROM d),
q AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM p),
m AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END])
    ELSE ws END AS ws FROM q),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM m),
e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
r AS (
  SELECT doc_id, start, length, min(q) AS period FROM (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island)
  WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
runs AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS o FROM r) WHERE o = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT m.doc_id, m.n AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM m LEFT JOIN runs USING (doc_id) LEFT JOIN best b ON b.doc_id = m.doc_id LEFT JOIN kept k ON k.doc_id = m.doc_id
"""
