"""Trees as leaf orders, met by sets of leaves: what a task does with the arrays of two trees.

An internal node of a binary tree stands between two leaves that follow each other, the last one of its first part and
the first one of its second: at place mid. So nodes are known by their places, the lowest common node of two leaves is
the largest one between them, and a set of leaves, in the order of their places, branches at as many nodes as it has neighbours.
Only there do both of a node's parts hold leaves of the set, so a set costs its own size, not the tree's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Leaves, of the nodes that meet other trees, that are looked at together. Leaves are found by a table if their numbers are below SPARSE times their count.
AT_ONCE, SPARSE = 1 << 16, 8


def lists(column) -> list[np.ndarray]:
    """The arrays of an Arrow column of lists of numbers, without a Python object for each number."""
    out = []
    for chunk in column.chunks if hasattr(column, "chunks") else [column]:
        values, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


class Order:
    """A tree by its leaf order and its nodes' intervals."""

    def __init__(self, order, start, mid, end):
        """``order``: numbers of the leaves; ``start``, ``mid``, ``end``: places of each node's two parts."""
        self.n, self.order = len(order), np.asarray(order)
        self.most = int(self.order.max()) + 1 if self.n else 0
        self.place = np.full(self.most, -1, np.int64)
        self.place[self.order] = np.arange(self.n)
        self.start, self.end = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        self.start[mid], self.end[mid] = start, end
        self.size = self.end - self.start
        #: largest[k][g]: the place of the largest node from g to g + 2**k - 1
        self.largest = [np.arange(self.n + 1)]
        while (step := 1 << len(self.largest) - 1) * 2 <= self.n:
            one = self.largest[-1]
            a, b = one[: self.n + 1 - 2 * step + 1], one[step : self.n + 1 - step + 1]
            self.largest.append(np.where(self.size[a] >= self.size[b], a, b))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of the lowest node above the leaves at places x < y."""
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            a, b = self.largest[k][x[at] + 1], self.largest[k][y[at] - (1 << k) + 1]
            out[at] = np.where(self.size[a] >= self.size[b], a, b)
        return out


class Own:
    """A tree whose nodes meet other trees: its nodes by their places, their children, and which of them are to be reached."""

    def __init__(self, order, start, mid, end, wanted):
        """``wanted``: places of the nodes that are asked about."""
        n = self.n = len(order)
        order = np.asarray(order)
        most = int(order.max()) + 1 if n else 0
        self.sorted = np.argsort(order).astype(np.int32) if most > SPARSE * n else None
        self.leaves = order if self.sorted is None else order[self.sorted]
        if self.sorted is None:
            self.place = np.full(most, -1, np.int32)
            self.place[order] = np.arange(n, dtype=np.int32)
        self.start, self.end = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        self.start[mid], self.end[mid] = start, end
        key = np.asarray(start).astype(np.int64) * (n + 1) + end
        by = np.argsort(key)
        key, at = key[by], np.asarray(mid)[by].astype(np.int32)

        def child(x, y):
            """The place of the node with leaves x to y; 0 for a leaf."""
            found = np.zeros(n + 1, np.int32)
            if len(key):
                asked = x.astype(np.int64) * (n + 1) + y
                i = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                found[mid] = np.where(key[i] == asked, at[i], 0)
            return found

        self.left, self.right = child(self.start[mid], np.asarray(mid)), child(np.asarray(mid), self.end[mid])
        wanted = np.asarray(wanted)
        upto = np.zeros(n + 2, np.int32)
        upto[wanted[self.end[wanted] - self.start[wanted] >= 3] + 1] = 1
        upto = np.cumsum(upto, dtype=np.int32)  # of wanted nodes before each place
        self.reached = upto[self.end] > upto[np.minimum(self.start + 1, n)]  # a node's own and those below it stand between its ends
        self.roots = np.asarray(mid)[np.asarray(end) - np.asarray(start) == n].astype(np.int32)

    def places(self, order: np.ndarray) -> np.ndarray:
        """Where the leaves stand; -1 for those that the tree lacks."""
        if self.sorted is not None:
            i = np.minimum(np.searchsorted(self.leaves, order), self.n - 1)
            return np.where(self.leaves[i] == order, self.sorted[i], np.int32(-1))
        there = order < len(self.place)
        if there.all():
            return self.place[order]
        return np.where(there, self.place[np.where(there, order, 0)] if len(self.place) else np.int32(-1), np.int32(-1))


class Met(NamedTuple):
    """Nodes of a tree with their leaves in other trees, some at a time.

    Each node (``node``, its place) stands for one other tree, from ``first`` on, ``size`` leaves: they are those of its
    leaves that the other tree has, in the other's order, by their places ``leaf`` in the own tree. The node of the
    other tree that branches before leaf i divides ``low[i]`` to i from i to ``high[i]``; ``which[i]`` is its number. Of its two
    parts ``a`` and ``b`` tell how many leaves belong to the own node's first and second part.
    """

    node: np.ndarray
    first: np.ndarray
    size: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    which: np.ndarray
    a: tuple[np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray]


def before(marks: np.ndarray) -> np.ndarray:
    """How many are marked before each place, and in all."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def _narrowed(own: Own, order, start, mid, end, number):
    """A tree without the leaves that the other one lacks; its nodes are numbered from ``number`` on, by their places."""
    leaf = own.places(np.asarray(order))
    kept = leaf >= 0
    upto = before(kept)
    low, at, high = upto[start], upto[mid], upto[end]
    both = np.flatnonzero((at > low) & (high > at))
    leaf = leaf[kept]
    out = [np.arange(len(leaf), dtype=np.int32) for _ in range(2)] + [np.zeros(len(leaf), np.int32)]
    for x, v in zip(out, (low, high, np.asarray(mid) + number), strict=True):
        x[at[both]] = v[both]
    return leaf, *out


def _together(states):
    """Some trees' leaves one after the other."""
    moved, n = [], 0
    for node, size, leaf, low, high, which in states:
        moved.append((node, size, leaf, low + np.int32(n), high + np.int32(n), which))
        n += len(leaf)
    return tuple(np.concatenate(x) for x in zip(*moved, strict=True))


def _half(met: Met, mine, leaf, low, at, high, child, size, alive):
    """The leaves of one part of each node: children that are ``alive``, with what is left of the nodes that branch among them."""
    both = np.flatnonzero((mine[0] > 0) & (mine[1] > 0))
    out = [np.arange(len(leaf), dtype=np.int32) for _ in range(2)] + [np.zeros(len(leaf), np.int32)]
    spot = at[both]
    for x, v in zip(out, (low, high, met.which), strict=True):
        x[spot] = v[both]
    if not alive.all():
        kept = np.repeat(alive, size)
        gone = np.where(alive, 0, size)
        moved = np.repeat((np.cumsum(gone) - gone).astype(np.int32), size)[kept]
        leaf, out = leaf[kept], [out[0][kept] - moved, out[1][kept] - moved, out[2][kept]]
        child, size = child[alive], size[alive]
    return child, size, leaf, *out


def descend(own: Own, trees: list) -> Iterator[Met]:
    """The reached nodes of a tree with each of some other trees (order, start, mid, end), from the root down.

    A node's leaves are kept in the other tree's order, with the nodes that branch among them; those of its two parts follow
    from them by running counts, so nothing is sorted or looked up, and a node costs its leaves. Nodes with fewer than three
    leaves that the other tree has are left out. At most about AT_ONCE leaves, or one node, are looked at together. Nodes of
    the other trees are numbered by their places, each tree's after those of the ones before, with their leaves and one more.
    """
    held, size, number = [], 0, 0
    for k, (order, start, mid, end) in enumerate(trees):
        leaf, *arrays = _narrowed(own, order, start, mid, end, number)
        number += len(order) + 1
        if len(own.roots) and len(leaf) >= 3 and own.reached[own.roots[0]]:
            held.append((own.roots, np.array([len(leaf)]), leaf, *arrays))
            size += len(leaf)
        if held and (size >= AT_ONCE or k + 1 == len(trees)):
            yield from _down(own, _together(held))
            held, size = [], 0


def _down(own: Own, state) -> Iterator[Met]:
    states = [state]
    while states:
        node, size, leaf, low, high, which = states.pop()
        first = np.cumsum(size) - size
        second = leaf >= np.repeat(node, size)
        upto, i = before(second), np.arange(len(leaf), dtype=np.int32)
        b_low, b_at, b_high = upto[low], upto[:-1], upto[high]
        a_low, a_at, a_high = low - b_low, i - b_at, high - b_high
        a, b = (a_at - a_low, a_high - a_at), (b_at - b_low, b_high - b_at)
        met = Met(node, first, size, leaf, low, high, which, a, b)
        yield met
        n_b = (upto[first + size] - upto[first]).astype(np.int64)
        n_a, left, right = size - n_b, own.left[node], own.right[node]
        halves = [
            _half(met, a, leaf[~second], a_low, a_at, a_high, left, n_a, own.reached[left] & (n_a >= 3)),
            _half(met, b, leaf[second], b_low, b_at, b_high, right, n_b, own.reached[right] & (n_b >= 3)),
        ]
        halves = [h for h in halves if len(h[0])]
        if sum(len(h[2]) for h in halves) > AT_ONCE:
            states += halves
        elif halves:
            states.append(_together(halves))


def agreement(own: Own, trees: list) -> np.ndarray:
    """By place, the sum over the trees of the triplets that each reached node and the other tree resolve alike."""
    total = np.zeros(own.n + 1, np.int64)
    for met in descend(own, trees):
        small = int(met.size.max()) <= 1024  # sums are below 2**31
        (ac, ad), (bc, bd) = ((x if small else x.astype(np.int64) for x in y) for y in (met.a, met.b))
        score = (ac * bd * (ac + bd - 2) + bc * ad * (bc + ad - 2)) >> 1
        np.add.at(total, met.node, np.add.reduceat(score, met.first, dtype=score.dtype).astype(np.int64))
    return total


def _product(x, y):
    """High and low 32 bits (high: as many as needed) of products of numbers below 2**62 that may exceed 64 bits."""
    x, y = x.astype(np.uint64), y.astype(np.uint64)
    k, m = np.uint64(32), np.uint64(0xFFFFFFFF)
    (x1, x0), (y1, y0) = (x >> k, x & m), (y >> k, y & m)
    low = x0 * y0
    return ((x1 * y1 << k) + x1 * y0 + x0 * y1 + (low >> k)).astype(np.int64), (low & m).astype(np.int64)


def quartets(own: Own, trees: list) -> tuple[np.ndarray, np.ndarray]:
    """By topology 1 to 3, or 4 for all, and by place: the quartets around the branches below each node, in all trees, as high and low 32 bits.

    Of a node with two internal children the four sets are their parts; with one, its parts, the leaf, and all other leaves.
    """
    high, low = np.zeros((4, own.n + 1), np.int64), np.zeros((4, own.n + 1), np.int64)
    sizes = np.concatenate([np.zeros((0, 2), np.int64), *(_sizes(*t) for t in trees)]).T
    last = np.cumsum([0, *(len(t[0]) + 1 for t in trees)])
    n_leaves = np.array([len(t[0]) for t in trees], np.int64)
    for met in descend(own, trees):
        x, y = own.left[met.node], own.right[met.node]
        left_leaf, one_leaf = x == 0, (x == 0) | (y == 0)
        cuts = np.where(x == 0, own.start[met.node], x), np.where(y == 0, own.end[met.node], y)
        first, second = (before(met.leaf >= np.repeat(c, met.size)) for c in cuts)
        every = lambda v: np.repeat(v, met.size)  # noqa: B023, E731
        at = np.arange(len(met.leaf))
        sides = []
        for k, (i, j) in enumerate(((met.low, at), (at, met.high))):
            a, b = met.a[k].astype(np.int64), met.b[k].astype(np.int64)
            l1, r1 = a + b - (first[j] - first[i]), (second[j] - second[i]).astype(np.int64)
            sides.append(_coloured(l1, a - l1, b - r1, r1, every(left_leaf), every(one_leaf), sizes[k][met.which] - a - b))
        ends = met.first + met.size
        n_a = np.add.reduceat(met.leaf < every(met.node), met.first, dtype=np.int64)
        n_b = met.size - n_a
        l1, r1 = met.size - (first[ends] - first[met.first]), (second[ends] - second[met.first]).astype(np.int64)
        # the tree is that of the node which branches before the second leaf
        tree = np.searchsorted(last, met.which[met.first + 1], "right") - 1
        own_sizes = _coloured(l1, n_a - l1, n_b - r1, r1, left_leaf, one_leaf, n_leaves[tree] - met.size)
        (a, c, e, g), (aa, cc, ee, gg) = sides
        wide = int(n_leaves.max()) > 4 * 46340  # else four sets' product is below 2**62
        found = [((a * c, ee * gg), (aa * cc, e * g)), ((a * e, cc * gg), (aa * ee, c * g)), ((a * g, cc * ee), (aa * gg, c * e))]
        for t, ((p, q), (r, s)) in enumerate(found):
            if wide:
                (h, w), (h_2, w_2) = _product(p, q), _product(r, s)
                h, w = (np.add.reduceat(v, met.first) for v in (h + h_2, w + w_2))
            else:
                v = np.add.reduceat(p * q + r * s, met.first)
                h, w = v >> 32, v & 0xFFFFFFFF
            np.add.at(high[t], met.node, h)
            np.add.at(low[t], met.node, w)
        h, w = _product(own_sizes[0] * own_sizes[1], own_sizes[2] * own_sizes[3])
        np.add.at(high[3], met.node, h)
        np.add.at(low[3], met.node, w)
    return high, low


def _sizes(order, start, mid, end) -> np.ndarray:
    """How many leaves the two parts of each node have, by its place."""
    out = np.zeros((len(order) + 1, 2), np.int64)
    out[mid, 0], out[mid, 1] = np.asarray(mid) - start, np.asarray(end) - mid
    return out


def _coloured(l1, l2, r1, r2, left_leaf, one_leaf, rest):
    """The four sets' leaves, of those of the parts' parts (of a leaf, the second in the first part, the first in the second) and all others."""
    return np.where(left_leaf, r1, l1), np.where(left_leaf, r2, l2), np.where(left_leaf, l2, r1), np.where(one_leaf, rest, r2)


class RangeIndex:
    """How many leaves any range of one order has in common with any range of another, in log n steps each, for many questions at once.

    The places in the second order, in the order of the first, are sorted bit by bit from the highest; of each step it is
    kept how many zeros there are up to each place.
    """

    def __init__(self, one, two):
        most = 1 + max((int(np.max(x)) for x in (one, two) if len(x)), default=0)
        place = np.full(most, -1, np.int64)
        place[two] = np.arange(len(two))
        values = place[one]
        self.upto = np.concatenate([[0], np.cumsum(values >= 0)])  # leaves that both have
        values = values[values >= 0]
        self.n, self.levels = len(two), []
        for bit in range(max(1, len(two).bit_length()) - 1, -1, -1):
            ones = values >> bit & 1 == 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~ones)]), int((~ones).sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def _below(self, low, high, value):
        """Leaves at kept places from low to high whose place in the second order is below value."""
        out, low, high = np.zeros(len(value), np.int64), low.copy(), high.copy()
        for bit, zeros, n_zeros in self.levels:
            one = value >> bit & 1 == 1
            z_low, z_high = zeros[low], zeros[high]
            out += np.where(one, z_high - z_low, 0)
            low = np.where(one, n_zeros + low - z_low, z_low)
            high = np.where(one, n_zeros + high - z_high, z_high)
        return out

    def common(self, start_1, end_1, start_2, end_2) -> np.ndarray:
        low, high = self.upto[start_1], self.upto[end_1]
        return self._below(low, high, np.asarray(end_2)) - self._below(low, high, np.asarray(start_2))
