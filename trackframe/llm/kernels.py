"""Vectorised byte kernels: substring hashes, words, sketches, banding, blobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text worked on at once; a longer document is one piece.
PIECE = 1 << 20
#: Entries of a power table, and positions hashed at once: what a core's cache holds.
LOW = 1 << 16
#: Positions below LOW * HIGH (2 GB) have powers.
HIGH = 1 << 15

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    x = x ^ U((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK) if seed else x.copy()
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to LOW - 1 of the base, and its powers LOW * i; of a size that no text changes."""
    if name not in _tables:
        base = _ODD if name == "up" else pow(_ODD, -1, 1 << 64)
        for part, b, size in (("", base, LOW), ("-high", pow(base, LOW, 1 << 64), HIGH)):
            t = np.full(size, U(b & _MASK))
            t[0] = 1
            _tables[name + part] = np.multiply.accumulate(t)
    return _tables[name], _tables[name + "-high"]


def unshift(at: np.ndarray) -> np.ndarray:
    """Inverse powers that make a hash independent of its place."""
    low, high = _powers("down")
    return low[at & (LOW - 1)] * high[at >> 16]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = mix(np.arange(1, 257, dtype=U), 77)
    return _tables["letters"]


def _prefix_parts(buf: np.ndarray):
    """Prefix sums by parts: (i, s) where s[j] covers buf[:i + j], for j up to the part's length."""
    low, high = _powers("up")
    letters, carry = _letters(), U(0)
    for i in range(0, len(buf), LOW):
        part = buf[i : i + LOW]
        s = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(letters[part] * low[: len(part)], out=s[1:])
        s *= high[i >> 16]
        s += carry
        carry = s[-1]
        yield i, s


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for span(): entry i covers buf[:i]. Eight bytes a byte: for buffers of bounded length."""
    out = np.zeros(len(buf) + 1, dtype=U)
    for i, s in _prefix_parts(buf):
        out[i : i + len(s)] = s
    return out


def _placed(difference: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(difference * unshift(a) + (b - a).astype(U) * U(0x9E6C63D0876A9A47))


def span(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of buf[a:b] for arrays of bounds; equal bytes give equal hashes anywhere."""
    return _placed(s[b] - s[a], a, b)


def spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """span() for ascending starts and ascending ends, without prefix sums of the whole buffer."""
    sa, sb = np.zeros(len(a), dtype=U), np.zeros(len(b), dtype=U)
    ia = ib = 0
    for i, s in _prefix_parts(buf):
        end = i + len(s) - (1 if i + len(s) - 1 < len(buf) else 0)
        ja, jb = np.searchsorted(a, end), np.searchsorted(b, end)
        sa[ia:ja], sb[ib:jb] = s[a[ia:ja] - i], s[b[ib:jb] - i]
        ia, ib = ja, jb
    return _placed(sb - sa, a, b)


def windows(s: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte windows of the buffer behind s."""
    n = len(s) - k
    if n <= 0:
        return np.zeros(0, dtype=U)
    low, high = _powers("down")
    out = s[k:] - s[:-k]
    for i in range(0, n, LOW):
        out[i : i + LOW] *= low[: min(LOW, n - i)] * high[i >> 16]
    return mix(out)


def rolled(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of k entries."""
    out = np.zeros(max(0, len(h) - k + 1), dtype=U)
    for i in range(0, len(out), LOW):
        part = out[i : i + LOW]
        for j in range(k):
            part = mix(part ^ h[i + j : i + j + len(part)], j + seed)
        out[i : i + LOW] = part
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (for integers a sort is much faster than np.unique's hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def texts(column: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(sizes: list[int], limit: int = PIECE, count: int = 1023):
    """Runs [i, j) of consecutive items of about limit bytes and count items at most."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and (total + n > limit or j - i >= count):
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each part, and the parts' starts and one more."""
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(0, np.uint8)
    return buf, starts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = np.ones(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    PLAIN[_a : _b + 1] = False


def words(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of the kind; buf ends with another byte."""
    w = kind[buf].view(np.int8)
    d = np.diff(w, prepend=np.int8(0))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def owners(starts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The text (of starts as joined() gives them) of each of the ascending places a."""
    cut = np.searchsorted(a, starts)
    return np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(cut))


def doc_shingles(parts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, A-Z lower-cased, words [^\\x20\\x09-\\x0D]+.

    Returns 54-bit shingle hashes, sorted and distinct inside a text, and the bounds of each
    text's run. A text with fewer words than k (but any) has its whole sequence as one
    shingle. At most 1,023 texts a call.
    """
    buf, starts = joined(parts)
    buf = LOWER[buf]
    a, b = words(buf, SPACED)
    doc = owners(starts, a)
    h = spans(buf, a, b)
    del a, b, buf
    count = np.bincount(doc, minlength=len(parts)) if len(h) else np.zeros(len(parts), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    both = rolled(h, k)
    both >>= U(10)
    if len(parts) > 1 and len(both):
        both |= doc[: len(both)].astype(U) << U(54)
        both = both[doc[: len(both)] == doc[k - 1 :]]
    for d in np.flatnonzero((count > 0) & (count < k)):
        x = np.zeros(1, dtype=U)
        for v in h[first[d] : first[d + 1]]:
            x = mix(x ^ v, 99)
        both = np.append(both, (U(d) << U(54)) | (mix(x, int(count[d])) >> U(10)))
    both = distinct(both)
    bounds = np.searchsorted(both >> U(54), np.arange(len(parts) + 1, dtype=U)) if len(parts) > 1 else np.array([0, len(both)])
    both &= U((1 << 54) - 1)
    return both, bounds


def set_ids(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each run's set of values; 0 for an empty set."""
    n = np.diff(bounds)
    total = np.concatenate([[U(0)], np.cumsum(mix(x, 5), dtype=U)])
    ids = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U) * U(_ODD), 6)
    ids[n == 0] = 0
    return ids


def sketch(x: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """Fast similarity sketches of n sets: an n x t matrix.

    Rounds of hashed placement: in round i < t each element falls into a hashed bin with a
    value that any earlier round undercuts; in round t + j every element falls into bin j, so
    after 2t rounds at the latest each coordinate of a set with an element is filled. A set
    leaves as soon as all its bins are filled. Two sets agree in a coordinate with
    probability equal to their Jaccard similarity, with concentration like independent
    hashing. Empty sets keep FULL everywhere.
    """
    out = np.full(n * t, FULL, dtype=U)
    live = np.zeros(n, dtype=bool)
    live[owner] = True
    for i in range(2 * t):
        if not len(x):
            break
        for at in range(0, len(x), LOW):
            h, own = mix(x[at : at + LOW], i + 101), owner[at : at + LOW].astype(np.int64) * t
            own += ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(out, own, (U(i) << U(32)) | (h & U(0xFFFFFFFF)))
        at = np.flatnonzero(live)
        open_ = (out.reshape(n, t)[at] == FULL).any(axis=1)
        live[at[~open_]] = False
        stay = live[owner]
        x, owner = x[stay], owner[stay]
    return out.reshape(n, t)


def filled_bins(chunks, n: int, t: int) -> np.ndarray:
    """One-permutation MinHash of n sets (repeats allowed), which come in chunks of (elements, owners):
    empty bins borrow the value of a hashed non-empty bin. Sets without elements keep FULL."""
    out = np.full(n * t, FULL, dtype=U)
    for x, owner in chunks:
        if t & (t - 1):
            place = (x >> U(32)) * U(t) >> U(32)
        else:  # the same for a power of two
            place = x >> U(65 - t.bit_length()) if t > 1 else np.zeros(len(x), dtype=U)
        place += owner.astype(U) * U(t)
        np.minimum.at(out, place.view(np.int64), x & U(0xFFFFFFFF))
    m = out.reshape(n, t)
    full = m != FULL
    need_r, need_c = np.nonzero(~full & full.any(axis=1)[:, None])
    step = 0
    while len(need_r):
        step += 1
        src = (mix(need_c.astype(U) * U(1 << 20) + U(step), 9) % U(t)).astype(np.int64)
        ok = full[need_r, src]
        m[need_r[ok], need_c[ok]] = m[need_r[ok], src[ok]]
        need_r, need_c = need_r[~ok], need_c[~ok]
    return m


def char_windows(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int):
    """Chunks of (hashes, owners) of the windows of k UTF-8 characters inside buf[begins:ends] (ascending,
    not empty, not overlapping); a shorter stretch is one window."""
    for x in range(0, len(buf), LOW):
        i, j = np.searchsorted(ends, x, side="right"), np.searchsorted(begins, x + LOW)
        if i == j:
            continue
        part = buf[x : x + LOW + 4 * k]
        mark = (part & 0xC0) != 0x80  # where characters start
        mark[begins[i:j][begins[i:j] >= x] - x] = True
        at = np.flatnonzero(mark)
        stop = np.append(at, len(part))
        s = prefix(part)
        # every window that starts before the next part, then those inside of one stretch
        n = min(len(stop) - k, int(np.searchsorted(at, LOW)))
        if n <= 0:
            h = s[:0]
        elif stop[n + k - 1] == n + k - 1:  # characters of one byte
            h = mix((s[k : n + k] - s[:n]) * _powers("down")[0][:n] + U(k))
        else:
            a, b = stop[:n], stop[k : n + k]
            h = mix((s[b] - s[a]) * _powers("down")[0][a] + (b - a).astype(U))
        first, last = begins[i:j] - x, ends[i:j] - x
        lo, hi = np.searchsorted(at, np.maximum(first, 0)), np.searchsorted(at, np.minimum(last, LOW))
        end = np.searchsorted(stop, last)  # past the part for a stretch that goes on: no window ends there
        end = np.where(last > len(part), len(stop), end)
        n = np.maximum(np.minimum(hi, end - k + 1) - lo, 0)
        owner = np.repeat(np.arange(i, j, dtype=np.int32), n)
        h = h[np.arange(len(owner)) + np.repeat(lo - np.cumsum(n) + n, n)]
        short = np.flatnonzero((first >= 0) & (end - lo < k))
        if len(short):
            a, b = first[short], last[short]
            h = np.append(h, mix((s[b] - s[a]) * unshift(a) + (b - a).astype(U)))
            owner = np.append(owner, (short + i).astype(np.int32))
        yield h, owner


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    """Band keys of a sketch matrix: n x (t // rows)."""
    n, t = m.shape
    b = t // rows
    cut = m.reshape(n, b, rows)
    key = np.broadcast_to(mix(np.arange(1, b + 1, dtype=U), 3), (n, b)).copy()
    for j in range(rows):
        key = mix(key ^ cut[:, :, j], j + 21)
    return key


# --- blobs: arrays dealt by key to buckets, so that a shuffle moves few large rows ---

BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
BLOB_DDL = "bucket int, kind tinyint, blob binary"
#: Entries of one key in one batch beyond which it is dealt as known to be shared.
HOT = 8


def deal(keys: np.ndarray, ids: np.ndarray, n_buckets: int, salt: int) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, kind, blob) for (key, id) entries of one batch.

    Kind 0 holds entries dealt by key. A key with over HOT ids in this batch is certainly
    shared: all of its entries travel as kind 1, dealt by an arbitrary bucket, and one of
    them stands for it in its own bucket. So a key of a third of all rows doesn't gather in
    one task.
    """
    order = np.argsort(keys)  # much faster than np.lexsort, which only keys that come again need
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    again = np.flatnonzero(again)
    ids[again] = ids[again][np.lexsort((ids[again], keys[again]))]
    new[1:] |= ids[1:] != ids[:-1]
    keys, ids = keys[new], ids[new]
    if not len(keys):
        return []
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(head, len(keys)))
    hot = np.repeat(size > HOT, size)
    rows = []
    if hot.any():
        rows.append((int(salt % n_buckets), 1, keys[hot].tobytes() + ids[hot].tobytes()))
        hot[head] = False
        keys, ids = keys[~hot], ids[~hot]
    bucket = ((keys >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        sl = slice(cut[b], cut[b + 1])
        rows.append((int(b), 0, keys[sl].tobytes() + ids[sl].tobytes()))
    return rows


class Dealer:
    """Collects (key, id) entries of many pieces and deals them together."""

    def __init__(self, n_buckets: int, entries: int = 1 << 16):
        self.n_buckets, self.entries, self.keys, self.ids, self.size, self.salt = n_buckets, entries, [], [], 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, bytes]]:
        """keys: n x bands, ids: n. Returns the rows that are due."""
        self.keys.append(keys.ravel())
        self.ids.append(np.repeat(ids, keys.shape[1]))
        self.size += keys.size
        return self.flush() if self.size >= self.entries else []

    def flush(self) -> list[tuple[int, int, bytes]]:
        if not self.size:
            return []
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.size, self.salt = [], [], 0, self.salt + 1
        return deal(keys, ids, self.n_buckets, self.salt * 7919 + int(ids[0] % U(1 << 20)))


def shared_entries(batches):
    """mapInArrow function over dealt blobs of whole buckets: (key, id) of keys with two ids
    or more."""
    keys, ids = [], []
    known_k, known_i = [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            half = len(blob) // 2
            k, i = np.frombuffer(blob, dtype=U, count=half // 8), np.frombuffer(blob, dtype=U, offset=half)
            (known_k if kind else keys).append(k)
            (known_i if kind else ids).append(i)
    if keys:
        k, i = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(k)
        k, i = k[order], i[order]
        same = np.zeros(len(k), dtype=bool)
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        k, i = k[same], i[same]
        # keys all of whose entries are one id have nothing to compare
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
        if len(k):
            differ = np.minimum.reduceat(i, head) != np.maximum.reduceat(i, head)
            keep = np.repeat(differ, np.diff(np.append(head, len(k))))
            known_k.append(k[keep])
            known_i.append(i[keep])
    for k, i in zip(known_k, known_i):
        for at in range(0, len(k), 100_000):
            yield pa.record_batch(
                [pa.array(k[at : at + 100_000].view(np.int64)), pa.array(i[at : at + 100_000].view(np.int64))], names=["key", "id"]
            )
