"""The numpy helper against plain definitions."""

import numpy as np
import pytest

from foldspark.functions import splitting as S


def random_graph(n, seed):
    rng = np.random.default_rng(seed)
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(p)) for p in rng.integers(0, n, (4 * n, 2)).tolist() if abs(p[0] - p[1]) > 1}
    i, j = np.array(sorted(pairs)).T
    return S.Edges(n, i, j, rng.random(len(i)))


def plain_modularity(e, block, resolution=1.0):
    inside = np.isin(np.arange(e.n), block)
    m, q = e.w.sum(), 0.0
    for side in (inside, ~inside):
        d = (e.w * (side[e.i].astype(float) + side[e.j])).sum()
        q += e.w[side[e.i] & side[e.j]].sum() / m - resolution * (d / (2 * m)) ** 2
    return q


@pytest.mark.parametrize("seed", range(4))
def test_continuous(seed):
    e = random_graph(70, seed)
    q, k = S.continuous(e, 10, 1.0)
    every = {k: plain_modularity(e, np.arange(k, 70)) for k in range(10, 61)}
    assert q == pytest.approx(max(every.values()), abs=1e-8) and every[k] == pytest.approx(q, abs=1e-8)


def test_middle_weights():
    for seed, n in ((0, 2), (1, 3), (2, 64), (3, 65), (4, 300)):
        e = random_graph(n, seed)
        t, v = np.divmod(np.arange(n * n), n)
        want = [e.w[(e.i > a) & (e.j <= b)].sum() for a, b in zip(t, v, strict=True)]
        assert np.allclose(S.middle_weights(e, t, v), want)


def test_discontinuous():
    e = random_graph(90, 5)
    q, t, v = S.discontinuous(e, 10, 30, 1.0)
    best = max((plain_modularity(e, np.arange(a + 1, b + 1)) for a, b in zip(e.i, e.j, strict=True) if 9 <= a <= 79 and b + 1 > a + 30 and b + 1 <= 80 and 90 - (b - a) >= 10))
    assert q == pytest.approx(best, abs=1e-8) and plain_modularity(e, np.arange(t + 1, v + 1)) == pytest.approx(q, abs=1e-8)


def test_pieces_cover_the_chain_and_merge():
    e = random_graph(200, 3)
    pieces = S.top_down(e, 0.05, 10, 30, 1.0)
    assert sorted(np.concatenate(pieces)) == list(range(200)) and len(pieces) > 1
    for mode in ("max", "avg", "min"):
        a, b = pieces[0], pieces[1]
        near = {x: set() for x in range(200)}
        for x, y in zip(e.i.tolist(), e.j.tolist(), strict=True):
            near[x].add(y)
            near[y].add(x)
        one, two = (np.mean([bool(near[x] & set(o.tolist())) for x in p.tolist()]) for p, o in ((a, b), (b, a)))
        assert S.Contacts(e, pieces).ratio(0, 1, mode) == pytest.approx({"max": max(one, two), "avg": (one + two) / 2, "min": min(one, two)}[mode])
    merged = S.bottom_up(e, pieces, 0.0)
    assert len(merged) == 1 and merged[0].tolist() == list(range(200))
    assert len(S.bottom_up(e, pieces, 2.0)) == len(pieces)
    assert len(S.bottom_up(e, pieces, 2.0, wanted=2)) == 2
    assert len(S.bottom_up_size_first(e, pieces, 2.0, wanted=2)) == 2


def plain_merged(near, start, ratio, mode, wanted):
    pieces, least = [list(p) for p in start], wanted or 1
    while len(pieces) > least:
        pairs = [(a, b) for a in range(len(pieces)) for b in range(a + 1, len(pieces))]
        a, b = max(pairs, key=lambda p: (plain_ratio(near, pieces[p[0]], pieces[p[1]], mode), -p[0], -p[1]))
        if plain_ratio(near, pieces[a], pieces[b], mode) < ratio and wanted is None:
            break
        pieces = [p for k, p in enumerate(pieces) if k not in (a, b)] + [sorted(pieces[a] + pieces[b])]
    return pieces


@pytest.mark.parametrize("seed", range(12))
def test_merging_of_random_pieces(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 90))
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (int(rng.integers(5, 3 * n)), 2)).tolist() if p[0] != p[1]}
    i, j = np.array(sorted(pairs)).T
    e = S.Edges(n, i, j, np.ones(len(i)))
    near = {x: {b for a, b in [*pairs, *((b, a) for a, b in pairs)] if a == x} for x in range(n)}
    owner = rng.integers(0, int(rng.integers(2, 15)), n)
    start = [np.flatnonzero(owner == k) for k in np.unique(owner)]
    for mode in ("max", "avg", "min"):
        for ratio, wanted in ((0.0, None), (0.3, None), (0.6, None), (0.6, 2), (2.0, 3)):
            got = [p.tolist() for p in S.bottom_up(e, start, ratio, mode, wanted)]
            assert got == plain_merged(near, [p.tolist() for p in start], ratio, mode, wanted)
            got = [p.tolist() for p in S.bottom_up_size_first(e, start, ratio, mode, wanted)]
            assert got == plain_size_first(near, [p.tolist() for p in start], ratio, mode, wanted)


def test_merging_of_a_long_chain_keeps_to_its_edges():
    """Memory is linear in edges: 2,000 pieces of 100,000 residues would be a table of 200 million."""
    import tracemalloc

    n = 100_000
    i = np.concatenate([np.arange(n - 1), np.arange(n - 7)])
    j = np.concatenate([np.arange(1, n), np.arange(7, n)])
    e = S.Edges(n, i, j, np.ones(len(i)))
    tracemalloc.start()
    merged = S.bottom_up(e, list(np.arange(n).reshape(2000, 50)), 0.1, wanted=10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merged) == 10 and sum(map(len, merged)) == n and peak < 100_000_000


def test_rewiring_keeps_degrees():
    e = random_graph(60, 1)
    r = S.rewired(e, 200, np.random.default_rng(0))
    degree = lambda g: np.bincount(g.i, minlength=60) + np.bincount(g.j, minlength=60)
    assert (degree(e) == degree(r)).all() and len(set(zip(r.i.tolist(), r.j.tolist(), strict=True))) == len(e.i)
    assert sorted(r.w) == sorted(e.w) and (r.i != e.i).any()


def fragment_modularity(e, nodes, block, resolution):
    """Modularity of a split of ``nodes`` into ``block`` and the rest, over the edges inside ``nodes``, edge by edge."""
    own, part = set(nodes), set(block)
    edges = [(i, j, w) for i, j, w in zip(e.i.tolist(), e.j.tolist(), e.w.tolist(), strict=True) if i in own and j in own]
    m, q = sum(w for *_, w in edges), 0.0
    for side in (part, own - part):
        q += sum(w for i, j, w in edges if i in side and j in side) / m
        q -= resolution * (sum(w * ((i in side) + (j in side)) for i, j, w in edges) / (2 * m)) ** 2
    return round(q, 9)


def plain_top_down(e, nodes, threshold, least, gap, resolution):
    """Split a fragment by trying every cut, then split both parts."""
    n, best = len(nodes), None
    for k in range(least, n - least + 1):
        q = fragment_modularity(e, nodes, nodes[k:], resolution)
        if best is None or q > best[0]:
            best = (q, nodes[:k], nodes[k:])
    place = {x: k for k, x in enumerate(nodes)}
    closing = sorted(tuple(sorted((place[i], place[j]))) for i, j in zip(e.i.tolist(), e.j.tolist(), strict=True) if i in place and j in place)
    for t, v in closing if n >= 2 * least else []:
        middle = v - t
        fits = least - 1 <= t <= n - least - 1 and v + 1 > t + max(gap, 1 + least) and v + 1 <= n - least
        if fits and middle >= least and n - middle >= least:
            q = fragment_modularity(e, nodes, nodes[t + 1 : v + 1], resolution)
            if best is None or q > best[0]:
                best = (q, nodes[: t + 1] + nodes[v + 1 :], nodes[t + 1 : v + 1])
    if best is None or best[0] < threshold:
        return [nodes]
    return [p for part in best[1:] for p in plain_top_down(e, part, threshold, least, gap, resolution)]


def blocks(n, seed):
    """A chain of compact blocks, the first beside the last: both kinds of split occur."""
    rng = np.random.default_rng(seed)
    block = np.arange(n) * 5 // n % 4
    pairs = {(i, i + 1) for i in range(n - 1)}
    pairs |= {(i, j) for i in range(n) for j in range(i + 2, n) if rng.random() < (0.3 if block[i] == block[j] else 0.01)}
    i, j = np.array(sorted(pairs)).T
    return S.Edges(n, i, j, rng.random(len(i)) + 0.2)


@pytest.mark.parametrize("seed", range(3))
def test_top_down_equals_the_plain_definition(seed):
    e = blocks(100, seed)
    got = [p.tolist() for p in S.top_down(e, 0.2, 8, 12, 1.0)]
    assert got == plain_top_down(e, list(range(100)), 0.2, 8, 12, 1.0) and len(got) > 2


def plain_ratio(near, a, b, mode):
    one, two = (sum(bool(near[x] & set(other)) for x in own) / len(own) for own, other in ((a, b), (b, a)))
    return {"max": max(one, two), "avg": (one + two) / 2, "min": min(one, two)}[mode]


def plain_size_first(near, start, ratio, mode, wanted):
    """The smallest piece first."""
    pieces, merging, least = [list(p) for p in start], True, wanted or 1
    key = lambda p: (len(p), min(p))
    while merging and len(pieces) > least:
        merging = False
        for a in sorted(pieces, key=key):
            partners = [b for b in pieces if b is not a and plain_ratio(near, a, b, mode) >= ratio]
            if partners:
                b = min(partners, key=key)
                pieces = [p for p in pieces if p is not a and p is not b] + [sorted(a + b)]
                merging = True
                break
    while wanted is not None and len(pieces) > least:
        a = min(pieces, key=key)
        b = min((p for p in pieces if p is not a), key=lambda p: (-round(plain_ratio(near, a, p, mode), 12), *key(p)))
        pieces = [p for p in pieces if p is not a and p is not b] + [sorted(a + b)]
    return pieces


@pytest.mark.parametrize("mode, wanted", [("max", None), ("avg", None), ("min", None), ("max", 3)])
def test_merging_equals_the_plain_definition(mode, wanted):
    e = blocks(120, 7)
    near = {x: set() for x in range(120)}
    for i, j in zip(e.i.tolist(), e.j.tolist(), strict=True):
        near[i].add(j)
        near[j].add(i)
    start = [list(range(k, k + 10)) for k in range(0, 120, 10)]
    pieces, least = [list(p) for p in start], wanted or 1
    while len(pieces) > least:
        pairs = [(a, b) for a in range(len(pieces)) for b in range(a + 1, len(pieces))]
        a, b = max(pairs, key=lambda p: (plain_ratio(near, pieces[p[0]], pieces[p[1]], mode), -p[0], -p[1]))
        if plain_ratio(near, pieces[a], pieces[b], mode) < 0.6 and wanted is None:
            break
        pieces = [p for k, p in enumerate(pieces) if k not in (a, b)] + [sorted(pieces[a] + pieces[b])]
    got = S.bottom_up(e, [np.array(p) for p in start], 0.6, mode, wanted)
    assert [p.tolist() for p in got] == pieces and len(pieces) < 12
    pieces = plain_size_first(near, start, 0.6, mode, wanted)
    got = S.bottom_up_size_first(e, [np.array(p) for p in start], 0.6, mode, wanted)
    assert [p.tolist() for p in got] == pieces
