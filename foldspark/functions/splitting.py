"""Recursive splitting and merging of one chain's contact graph, on numpy arrays of its edges."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Edges:
    """Edges i < j of a chain of n residues with weights."""

    n: int
    i: np.ndarray
    j: np.ndarray
    w: np.ndarray

    def within(self, nodes: np.ndarray) -> Edges:
        """Edges inside ``nodes``, with places in ``nodes`` for residues."""
        place = np.full(self.n, -1)
        place[nodes] = np.arange(len(nodes))
        a, b = place[self.i], place[self.j]
        keep = (a >= 0) & (b >= 0)
        return Edges(len(nodes), np.minimum(a, b)[keep], np.maximum(a, b)[keep], self.w[keep])


def modularity(inside: np.ndarray, degree: np.ndarray, total: float, resolution: float) -> np.ndarray:
    return (total - degree + 2 * inside) / total - resolution * (((2 * total - degree) / (2 * total)) ** 2 + (degree / (2 * total)) ** 2)


def _degrees(e: Edges) -> np.ndarray:
    return np.bincount(e.i, e.w, e.n) + np.bincount(e.j, e.w, e.n)


def continuous(e: Edges, min_len: int, resolution: float, allowed: np.ndarray | None = None) -> tuple[float, int] | None:
    """(q, first place of the right piece) of the best cut; the first on ties to nine digits."""
    total = e.w.sum()
    if e.n < 2 * min_len or total <= 0:
        return None
    inside = np.bincount(e.i, e.w, e.n)[::-1].cumsum()[::-1]
    degree = _degrees(e)[::-1].cumsum()[::-1]
    at = np.arange(min_len, e.n - min_len + 1)
    if allowed is not None:
        at = at[np.isin(at, allowed)]
    if not len(at):
        return None
    q = np.round(modularity(inside[at], degree[at], total, resolution), 9)
    best = int(q.argmax())
    return float(q[best]), int(at[best])


def middle_weights(e: Edges, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Weight of the edges inside (t, v] for each pair.

    i > t holds at exactly one binary place, where i has 1, t has 0 and all higher places agree. At every place, edges
    sorted by (higher places, j) answer all pairs by two look-ups in their running sum: (edges + pairs) log n in all.
    """
    out = np.zeros(len(t))
    for level in range(max(1, int(e.n - 1).bit_length())):
        own, asked = np.flatnonzero(e.i >> level & 1), np.flatnonzero(~(t >> level) & 1)
        if not len(own) or not len(asked):
            continue
        keys = (e.i[own] >> level + 1) * (e.n + 1) + e.j[own]
        order = np.argsort(keys, kind="stable")
        keys, upto = keys[order], np.concatenate([[0.0], e.w[own][order].cumsum()])
        base = (t[asked] >> level + 1) * (e.n + 1)
        first, last = np.searchsorted(keys, base), np.searchsorted(keys, base + v[asked], "right")
        out[asked] += upto[last] - upto[first]
    return out


def discontinuous(e: Edges, min_len: int, min_gap: int, resolution: float) -> tuple[float, int, int] | None:
    """(q, t, v) of the best middle piece (t, v] closed by an edge; the first on ties to nine digits."""
    total = e.w.sum()
    if e.n < 2 * min_len or total <= 0:
        return None
    t, v = e.i, e.j
    middle = v - t
    keep = (t >= min_len - 1) & (t <= e.n - min_len - 1) & (v + 1 > t + max(min_gap, 1 + min_len)) & (v + 1 <= e.n - min_len) & (middle >= min_len) & (e.n - middle >= min_len)
    if not keep.any():
        return None
    t, v = t[keep], v[keep]
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    upto = np.concatenate([[0.0], _degrees(e).cumsum()])
    q = np.round(modularity(middle_weights(e, t, v), upto[v + 1] - upto[t + 1], total, resolution), 9)
    best = int(q.argmax())
    return float(q[best]), int(t[best]), int(v[best])


def best_split(e: Edges, nodes: np.ndarray, min_len: int, min_gap: int, resolution: float, cuts: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(q, A, B): the better of both kinds of cut, the continuous one on ties. ``cuts`` are places k of the chain; on a
    fragment with holes they stand for the offset k - first residue, as in a whole chain."""
    local = e.within(nodes)
    one = continuous(local, min_len, resolution, None if cuts is None else cuts[(cuts > nodes[0]) & (cuts <= nodes[-1])] - nodes[0])
    two = discontinuous(local, min_len, min_gap, resolution)
    if one is not None and (two is None or one[0] >= two[0]):
        return one[0], nodes[: one[1]], nodes[one[1] :]
    if two is None:
        return None
    q, t, v = two
    return q, np.concatenate([nodes[: t + 1], nodes[v + 1 :]]), nodes[t + 1 : v + 1]


def top_down(
    e: Edges,
    threshold: float,
    min_len: int,
    min_gap: int,
    resolution: float,
    cuts: np.ndarray | None = None,
    nodes: np.ndarray | None = None,
) -> list[np.ndarray]:
    """Pieces of the chain, or of its fragment ``nodes``, after splitting while q >= ``threshold``, left part first. No
    cuts at all: all places."""
    if cuts is not None and not len(cuts):
        cuts = None
    waiting, out = [np.arange(e.n) if nodes is None else nodes], []
    while waiting:
        nodes = waiting.pop()
        found = best_split(e, nodes, min_len, min_gap, resolution, cuts)
        if found is None or found[0] < threshold:
            out.append(nodes)
        else:
            waiting += [found[2], found[1]]
    return out


class Contacts:
    """Which residues touch which piece, kept up to date as pieces merge.

    ``touching[a]`` are the residues that touch piece a, and ``count[a][b]`` is how many residues of a touch b, for the
    pieces that touch at all. The smaller set always joins the larger one, so all merges together cost E log E steps, and
    memory is linear in edges. Pieces have growing numbers; a merged piece gets the next.
    """

    def __init__(self, e: Edges, pieces: list[np.ndarray]):
        self.members = {k: p.tolist() for k, p in enumerate(pieces)}
        self.least = {k: min(p, default=-1) for k, p in self.members.items()}
        self.next = len(pieces)
        owner = np.full(e.n, -1)
        for k, p in enumerate(pieces):
            owner[p] = k
        ends, others = np.concatenate([e.i, e.j]), np.concatenate([e.j, e.i])
        inside = (owner[ends] >= 0) & (owner[others] >= 0)
        pairs = np.unique(ends[inside] * max(1, len(pieces)) + owner[others[inside]])
        residues, touched = np.divmod(pairs, max(1, len(pieces)))
        # A residue's slot, and the piece that has the slot now: a merge gives new slots to the smaller piece only.
        self.slot, self.holder = owner.tolist(), {k: k for k in self.members}
        self.home = dict(self.holder)
        self.touching: dict[int, set[int]] = {k: set() for k in self.members}
        self.count: dict[int, dict[int, int]] = {k: defaultdict(int) for k in self.members}
        for x, k in zip(residues.tolist(), touched.tolist(), strict=True):
            self.touching[k].add(x)
            if self.slot[x] != k:
                self.count[self.slot[x]][k] += 1

    def ratio(self, a: int, b: int, mode: str) -> float:
        one = self.count[a].get(b, 0) / len(self.members[a]) if self.members[a] else 0.0
        two = self.count[b].get(a, 0) / len(self.members[b]) if self.members[b] else 0.0
        return float({"max": max(one, two), "avg": (one + two) / 2, "min": min(one, two)}[mode])

    def near(self, a: int) -> Iterator[int]:
        """Pieces that touch ``a``."""
        return iter(self.count[a])

    def merge(self, a: int, b: int) -> int:
        """The number of the merged piece."""
        new, self.next = self.next, self.next + 1
        small, large = sorted((a, b), key=lambda k: len(self.touching[k]))
        # Residues of other pieces that touch both count once from now on.
        both: dict[int, int] = defaultdict(int)
        held = self.touching.pop(large)
        for x in self.touching.pop(small):
            if x in held:
                both[self.holder[self.slot[x]]] += 1
            else:
                held.add(x)
        self.touching[new] = held
        one, two = self.count.pop(a), self.count.pop(b)
        self.count[new] = defaultdict(int)
        for c in (set(one) | set(two)) - {a, b}:
            self.count[new][c] = one.get(c, 0) + two.get(c, 0)
            theirs = self.count[c]
            theirs[new] = theirs.pop(a, 0) + theirs.pop(b, 0) - both.get(c, 0)
        few, many = sorted((a, b), key=lambda k: len(self.members[k]))
        home = self.home.pop(many)
        del self.holder[self.home.pop(few)]
        self.home[new], self.holder[home] = home, new
        moved = self.members.pop(few)
        for x in moved:
            self.slot[x] = home
        self.members[new] = self.members.pop(many)
        self.members[new] += moved
        self.least[new] = min(self.least.pop(a), self.least.pop(b))
        return new

    def key(self, k: int) -> tuple[int, int]:
        return len(self.members[k]), self.least[k]

    def pieces(self) -> list[np.ndarray]:
        """In order of their numbers."""
        return [np.sort(np.array(p, np.int64)) for _, p in sorted(self.members.items())]


def bottom_up(e: Edges, pieces: list[np.ndarray], ratio: float, mode: str = "max", wanted: int | None = None) -> list[np.ndarray]:
    """Merge the pair of largest contact ratio (the first on ties) while it reaches ``ratio``. With ``wanted`` pieces:
    never fewer, and merging goes on below ratio until they are reached. A merge renews the merged piece's ratios.

    Pairs that touch wait in a heap; pairs of merged pieces are skipped when they come up."""
    held = Contacts(e, pieces)
    least = 1 if wanted is None else max(1, wanted)
    heap = [(-held.ratio(a, b, mode), a, b) for a in held.members for b in held.near(a) if a < b]
    heapq.heapify(heap)
    while len(held.members) > least:
        while heap and not (heap[0][1] in held.members and heap[0][2] in held.members):
            heapq.heappop(heap)
        if heap:
            best, a, b = heapq.heappop(heap)
        else:  # no pieces touch: the first two have ratio 0, like all others
            best, (a, b) = 0.0, sorted(held.members)[:2]
        if -best < ratio and wanted is None:
            break
        new = held.merge(a, b)
        for c in held.near(new):
            heapq.heappush(heap, (-held.ratio(c, new, mode), c, new))
    return held.pieces()


def bottom_up_size_first(e: Edges, pieces: list[np.ndarray], ratio: float, mode: str = "min", wanted: int | None = None) -> list[np.ndarray]:
    """The smallest piece joins the smallest partner that it touches in ``ratio``; then, down to ``wanted`` pieces, the
    smallest joins its best partner.

    Pieces wait in a heap by size. One without partners leaves it until a merge makes a neighbour that it touches in
    ``ratio``; no other merge can give it a partner."""
    held = Contacts(e, pieces)
    least = 1 if wanted is None else max(1, wanted)

    def fits(a: int) -> Iterator[int]:
        others = held.near(a) if ratio > 0 else (b for b in held.members if b != a)
        return (b for b in others if held.ratio(a, b, mode) >= ratio)

    heap = [(held.key(a), a) for a in held.members]
    heapq.heapify(heap)
    while heap and len(held.members) > least:
        _, a = heapq.heappop(heap)
        if a not in held.members or (b := min(fits(a), key=held.key, default=None)) is None:
            continue
        new = held.merge(a, b)
        for c in [new, *held.near(new)]:
            if c == new or held.ratio(c, new, mode) >= ratio:
                heapq.heappush(heap, (held.key(c), c))
    heap = [(held.key(a), a) for a in held.members]
    heapq.heapify(heap)
    while wanted is not None and len(held.members) > least:
        _, a = heapq.heappop(heap)
        if a not in held.members:
            continue
        near = list(held.near(a)) or [b for b in held.members if b != a]
        new = held.merge(a, min(near, key=lambda b: (-round(held.ratio(a, b, mode), 12), held.key(b))))
        heapq.heappush(heap, (held.key(new), new))
    return held.pieces()


def labels_of(n: int, pieces: list[np.ndarray]) -> np.ndarray:
    out = np.full(n, -1)
    for k, p in enumerate(pieces):
        out[p] = k
    return out


def rewired(e: Edges, swaps: int, rng: np.random.Generator) -> Edges:
    """Degree-preserving swaps of edge ends, and weights shuffled if they differ."""
    i, j = e.i.tolist(), e.j.tolist()
    known = set(zip(i, j, strict=True))
    m, done = len(i), 0
    for a, b, flip in zip(*(rng.integers(0, k, 10 * swaps + 100).tolist() for k in (m, m, 2)), strict=True):
        if done >= swaps:
            break
        u, x, v, y = i[a], j[a], i[b], j[b]
        if flip:
            v, y = y, v
        if len({u, x, v, y}) < 4:
            continue
        one, two = (min(u, v), max(u, v)), (min(x, y), max(x, y))
        if one in known or two in known:
            continue
        known -= {(i[a], j[a]), (i[b], j[b])}
        known |= {one, two}
        (i[a], j[a]), (i[b], j[b]) = one, two
        done += 1
    w = rng.permutation(e.w) if np.ptp(e.w) > 1e-12 else e.w
    return Edges(e.n, np.array(i), np.array(j), w)
