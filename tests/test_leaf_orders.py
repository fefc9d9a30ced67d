"""Trees as leaf orders: nodes that meet other trees, against counts by sets, and what tasks hold at a time."""

import numpy as np
import pyarrow as pa
import pytest

from cladeworks.operators import orders, splits, weights
from cladeworks.sources import newick


def _tree(order):
    """order, start, mid, end of a tree that halves an order of leaves."""
    nodes, left = [], [(0, len(order))]
    while left:
        s, e = left.pop()
        if e - s > 1:
            nodes.append((s, (s + e) // 2, e))
            left += [(s, (s + e) // 2), ((s + e) // 2, e)]
    return np.array(order), *np.array(sorted(nodes, key=lambda x: x[1]), np.int32).reshape(-1, 3).T


@pytest.mark.parametrize("at_once", [8, 1 << 16])
def test_nodes_meet_trees(monkeypatch, at_once):
    """Triplets and quartets of each node by its leaves, against counts over all leaves, in trees that lack some; a task gives a row for a tree, not one for a split."""
    monkeypatch.setattr(orders, "AT_ONCE", at_once)
    draw = np.random.default_rng(3)
    own, *others = (_tree(draw.permutation(14)[:k]) for k in (13, 14, 9, 2, 12))
    wanted = own[2][::2]
    got = orders.agreement(orders.Own(*own, wanted), others)
    high, low = orders.quartets(orders.Own(*own, own[2]), others)
    assert len(others) == 4
    split = lambda t: [(set(t[0][s:m].tolist()), set(t[0][m:e].tolist())) for s, m, e in zip(*t[1:], strict=True)]
    pair = lambda p, q: p * q * (p + q - 2) // 2
    sides = {frozenset(a | b): (a, b) for a, b in split(own)}
    for (a, b), m in zip(split(own), own[2].tolist(), strict=True):
        every = [(len(a & c), len(b & d), len(a & d), len(b & c)) for t in others for c, d in split(t)]
        if m in wanted:
            assert got[m] == sum(pair(p, q) + pair(r, s) for p, q, r, s in every)
        x, y = sides.get(frozenset(a)), sides.get(frozenset(b))
        if x or y:
            q = [*x, *y] if x and y else [*(x or y), b if x else a, set(range(14)) - a - b]
            counts = np.zeros(4, int)
            for t in others:
                for c, d in split(t):
                    n = [(len(z & c), len(z & d)) for z in q]
                    for k, (i, j, v, w) in enumerate(((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))):
                        counts[k] += n[i][0] * n[j][0] * n[v][1] * n[w][1] + n[i][1] * n[j][1] * n[v][0] * n[w][0]
                counts[3] += np.prod([len(z & set(t[0].tolist())) for z in q])
            assert (high[:, m] * 2**32 + low[:, m]).tolist() == counts.tolist()
    pack = lambda trees: {c: pa.array([x.tolist() for x in column]) for c, column in zip(("order", "start", "mid", "end"), zip(*trees, strict=True), strict=True)}
    rows = weights._ranges(pa.table(pack([own, own]) | {"tree_id": [1, 2], "wanted": [wanted.tolist()] * 2}), pa.table(pack(others)))
    assert rows.num_rows == 2 and rows["part"].to_pylist() == [got[wanted].tolist()] * 2


def test_sparse_numbers():
    """Leaves whose numbers are far apart take no table of all numbers."""
    own = _tree(np.arange(40) * 10**12)
    assert orders.agreement(orders.Own(*own, own[2]), [own]).tolist() == orders.agreement(orders.Own(*_tree(np.arange(40)), own[2]), [_tree(np.arange(40))]).tolist()


def test_large_batches_in_parts(monkeypatch):
    """What a task parses, or makes nodes of, together is bounded by leaves, not by the rows of a batch."""
    monkeypatch.setattr(newick, "AT_ONCE", 100)
    monkeypatch.setattr(splits, "LEAVES", 10)
    lines = ["(" * 9 + "a" + "".join(f",b{i})" for i in range(9)) + ";"] * 7
    batch = pa.record_batch({"tree_id": list(range(7)), "text": lines})
    parts = list(newick._shapes([batch]))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 7
    whole = pa.Table.from_batches(parts).to_pydict()
    monkeypatch.setattr(newick, "AT_ONCE", 1 << 21)
    assert whole == pa.Table.from_batches(newick._shapes([batch])).to_pydict()
    words = {f"w{i}": pa.array([list(range(10))] * 7, pa.list_(pa.int64())) for i in range(2)}
    nodes = pa.record_batch({"tree_id": list(range(7))} | words | {c: whole[c] for c in ("start", "mid", "end")})
    found = list(splits._sides(2)([nodes]))
    monkeypatch.setattr(splits, "LEAVES", 1000)
    assert len(found) == 7 and pa.Table.from_batches(found).to_pydict() == pa.Table.from_batches(splits._sides(2)([nodes])).to_pydict()


def test_quartets_beyond_64_bits():
    """A branch's sets of 60,000 leaves each have more quartets than 64 bits hold."""
    own = _tree(np.arange(240_000))
    high, low = orders.quartets(orders.Own(*own, own[2]), [own])
    found = [int(h) * 2**32 + int(x) for h, x in zip(high[:, 120_000], low[:, 120_000], strict=True)]
    assert found == [60_000**4, 0, 0, 60_000**4]
