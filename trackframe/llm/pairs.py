"""Exact links between the sets of one cluster of candidates: which pairs have den * |both| >= num * |either|.

First a few rounds compare each bucket's first sets with its others, which settles copies and near copies of a few texts in as many
comparisons as there are sets. What is left, such as families of texts from one template that are not similar enough, is compared as a whole, in
time that is quadratic but a product of matrices: sets are pruned that share too few of their values with others, the commonest values are the columns of a
matrix, whose product counts what pairs have in common, and rarer values are added by the lists of the sets that hold them. No link that could join two components is lost.
"""

from __future__ import annotations

import numpy as np

#: Values of pairs compared at once.
COMPARED = 1 << 20
#: Rounds of leaders, after which a bucket that still holds two components is compared as a whole.
ROUNDS = 4
#: A value in over a COMMON-th of the sets is worth a column.
COMMON = 20
#: Columns, cells and pairs of the matrices held at once.
COLUMNS, CELLS, PAIRS = 2048, 1 << 25, 1 << 21


class Sets:
    """Sets of different numbers, one after the other, and the label of each one's component (the component's first place)."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.size = np.fromiter((len(x) for x in sets), dtype=np.int64, count=len(sets))
        self.values = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if len(sets) else np.zeros(0, np.int32)
        self.at = np.cumsum(self.size) - self.size
        self.label = np.arange(len(sets))
        self.num, self.den = num, den

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a[i] and b[i]."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]

    def of(self, own: np.ndarray) -> np.ndarray:
        """The values of the sets ``own``, one set after the other."""
        n = self.size[own]
        return self.values[np.arange(n.sum()) + np.repeat(self.at[own] - np.cumsum(n) + n, n)]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a, b) are linked."""
        size, num, den = self.size, self.num, self.den
        out = np.zeros(len(a), dtype=bool)
        todo = np.flatnonzero(den * np.minimum(size[a], size[b]) >= num * np.maximum(size[a], size[b]))
        ends = np.cumsum(size[a[todo]] + size[b[todo]])
        i = 0
        while i < len(todo):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, side="right")))
            pick = todo[i:j]
            sets, own = np.concatenate([a[pick], b[pick]]), np.tile(np.arange(len(pick)), 2)
            # values are numbers below 2^31, pairs below 2^32
            x = np.sort((np.repeat(own, size[sets]) << 31) | self.of(sets))
            both = np.bincount(x[1:][x[1:] == x[:-1]] >> 31, minlength=len(pick))
            out[pick] = den * both >= num * (size[a[pick]] + size[b[pick]] - both)
            i = j
        return out

    def pruned(self, own: np.ndarray) -> np.ndarray:
        """Those of the sets ``own`` that share so many values with others of them that they may have a link."""
        for _ in range(8):
            if len(own) < 2:
                return own[:0]
            v = self.of(own)
            count = np.bincount(v)
            n = self.size[own]
            shared = np.add.reduceat(count[v] > 1, np.cumsum(n) - n, dtype=np.int64)
            keep = self.den * shared >= self.num * n
            if keep.all():
                break
            own = own[keep]
        return own

    def compare_all(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Merges all links between sets of ``left`` (no empty ones), or between left and right."""
        own = self.pruned(left if right is None else np.concatenate([left, right]))
        if len(own) < 2 or (self.label[own] == self.label[own[0]]).all():
            return
        own = own[np.argsort(self.size[own], kind="stable")]
        n, v, rows = self.size[own], self.of(own), len(own)
        row, count = np.repeat(np.arange(rows), n), np.bincount(v)
        common = np.flatnonzero(count > max(1, rows // COMMON))
        most = min(COLUMNS, max(64, CELLS // rows))
        if len(common) > most:
            common = common[np.argpartition(count[common], -most)[-most:]]
        column = np.full(len(count), -1, dtype=np.int32)
        column[common] = np.arange(len(common))
        where = column[v]
        matrix = np.zeros((rows, len(common)), dtype=np.float32)
        matrix[row[where >= 0], where[where >= 0]] = 1
        # the sets that hold each value without a column
        rare = (where < 0) & (count[v] > 1)
        row, v = row[rare], v[rare]
        holders = row[np.argsort(v, kind="stable")]
        known = np.bincount(v, minlength=len(count))
        begin = np.cumsum(known) - known
        entry = np.searchsorted(row, np.arange(rows + 1))
        side = None if right is None else np.isin(own, left)
        size = n.astype(np.float32)
        i = 0
        while i < rows:
            j = min(rows, i + max(1, PAIRS // (rows - i)))
            high = int(np.searchsorted(n, n[j - 1] * self.den // self.num, side="right"))
            both = matrix[i:j] @ matrix[i:high].T
            self._add_rare(both, i, high, row, v, holders, begin, known, entry[i], entry[j])
            # den * both >= num * (sizes - both)
            a, b = np.nonzero((self.num + self.den) * both >= self.num * (size[i:j, None] + size[None, i:high]))
            later = b > a
            a, b = a[later] + i, b[later] + i
            if side is not None:
                cross = side[a] != side[b]
                a, b = a[cross], b[cross]
            self.merge(own[a], own[b])
            i = j

    @staticmethod
    def _add_rare(both, i, high, row, v, holders, begin, known, first, last):
        """Adds the shared values without a column to the cells of rows from i on."""
        x = first
        ends = np.cumsum(known[v[first:last]])
        while x < last:
            y = first + max(x - first + 1, int(np.searchsorted(ends, (ends[x - first - 1] if x > first else 0) + COMPARED, side="right")))
            k = known[v[x:y]]
            other = holders[np.arange(k.sum()) + np.repeat(begin[v[x:y]] - np.cumsum(k) + k, k)]
            mine = np.repeat(row[x:y], k) - i
            live = (other >= i) & (other < high)
            cell = mine[live] * both.shape[1] + other[live] - i
            if len(cell) > both.size // 16:
                both += np.bincount(cell, minlength=both.size).reshape(both.shape)
            elif len(cell):
                np.add.at(both.reshape(-1), cell, 1)
            x = y


def linked(sets: list[np.ndarray], node: np.ndarray, key: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels of the components of the links between sets that share a bucket; (node[i], key[i]) says that a set is in a bucket.
    The label is the component's first place.

    In a round each bucket's first set is compared with the bucket's sets of other components and then leaves it; buckets of one component are done.
    After ROUNDS rounds the sets of buckets that overlap are compared all with all."""
    s = Sets(sets, num, den)
    label = s.label
    order = np.lexsort((node, key))
    node, key = node[order], np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)

    def open_buckets(node, key):
        if not len(node):
            return node, key, node, node
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(first, append=len(key))
        keep = np.repeat(np.minimum.reduceat(label[node], first) != np.maximum.reduceat(label[node], first), n)
        node, key = node[keep], key[keep]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return node, key, first, np.diff(first, append=len(key))

    node, key, first, n = open_buckets(node, key)
    for _ in range(ROUNDS):
        if not len(node):
            return label
        lead = np.repeat(node[first], n)
        other = label[lead] != label[node]
        pairs = np.unique(np.minimum(lead, node)[other] * len(sets) + np.maximum(lead, node)[other])
        a, b = pairs // len(sets), pairs % len(sets)
        good = s.alike(a, b)
        s.merge(a[good], b[good])
        stay = np.ones(len(node), dtype=bool)
        stay[first] = False
        node, key, first, n = open_buckets(node[stay], key[stay])
    if len(node):  # the leaders of the rounds are compared with all of their buckets: the others are what is left
        group = Sets([np.zeros(0, np.int64)] * len(sets), num, den)
        group.merge(np.repeat(node[first], n), node)
        own = np.unique(node)
        of = group.label[own]
        by = np.argsort(of, kind="stable")
        for part in np.split(own[by], np.flatnonzero(np.diff(of[by])) + 1):
            s.compare_all(part)
    return label
