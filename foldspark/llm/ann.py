"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one entry, held with as many of their smallest ids as a result can use (partial top-k per vector, so
a vector that fills a third of the table costs one graph node). Entries are hashed to shards of a bounded number of
vectors; each shard is built in one task into flat arrays: vectors, and for every level the members and a fixed-width
table of neighbours. Queries go, in blocks of bounded bytes, to every shard; a task searches one block in one shard, and
the best ``k`` per query are merged by a window over (query, score). How wide a beam a graph needs is measured on a few
of the block's own queries. A graph is copied once for each block, a query once for each shard: the second is the larger
part and grows with queries times vectors / ``SHARD_ROWS``.

Building draws levels from a hash, and links every vector to the nearest vectors inserted before it on each of its
levels; those are found by blocked matrix products inside the shard instead of a beam search, so the graph does not
depend on earlier mistakes. Neighbours are picked by the usual diversity rule, links are kept both ways, and overfull
lists are pruned by the same rule.

Largest inner product is turned into nearest by length: within a shard every vector gets one more coordinate that makes
all lengths equal. That works best if lengths are alike, so shards hold bands of lengths (a factor of 1.25 wide, short
bands joined with the next, long ones split by hash). Scores that leave this module are inner products of the original
vectors in double precision.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; nor do vectors of another
length than most. Fewer than ``k`` candidates: all of them. Ties go to the smaller id; a query never meets its own id.
Rows with null ids take no part. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut
from .wordhash import mix

LINKS = 16
#: Beam of a search in 64 dimensions or fewer, what it grows by when dimensions double, and vectors of a shard. On Gaussian
#: vectors without clusters recall at 20 in one full shard is then 0.96 or more from 64 to 768 dimensions (``breadth_for``).
BREADTH, MORE_BREADTH = 384, 256
SHARD_ROWS = 8192
#: Where no beam is given, each block of queries measures the one it needs in each shard: with so many of its queries,
#: from the least beam up by thirds, until this share of their nearest is found (of as many as one shard of a band
#: holds), to so many times ``breadth_for`` at most.
PROBES, LEAST_BREADTH, RECALL, MOST_BREADTH = 64, 96, 0.995, 4
#: Ratio of lengths in a band, and the entries below which a band is joined with the next.
BAND, BAND_ROWS = 1.25, 512
#: Queries that are searched together, and bytes of a block of queries that a task holds.
TOGETHER, BLOCK_BYTES = 512, 1 << 25
_INDEX = "shard int, parts int, dims int, vectors binary, levels array<int>, members array<int>, neighbours array<int>, ids array<array<bigint>>"


def breadth_for(dims: int) -> int:
    """The beam that Gaussian vectors of ``dims`` dimensions need."""
    return BREADTH + int(MORE_BREADTH * np.log2(max(dims, 64) / 64))


def _pick(base: np.ndarray, own: np.ndarray, near: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` of the candidates ``near`` (best first, -1 for none) of each of ``own``, by the diversity rule.

    A candidate nearer to a picked neighbour than to the vector itself is passed over at first; free places then go to
    the best of those.
    """
    rows, c = near.shape
    out = np.full((rows, m), -1, np.int32)
    for lo in range(0, rows, 512):
        part, sim = near[lo : lo + 512], sims[lo : lo + 512]
        vectors = base[np.maximum(part, 0)]
        among = vectors @ vectors.transpose(0, 2, 1)
        valid = part >= 0
        picked = np.zeros(part.shape, bool)
        n = np.zeros(len(part), int)
        for j in range(c):
            blocked = (picked & (among[:, j, :] > sim[:, j : j + 1])).any(axis=1)
            picked[:, j] = valid[:, j] & ~blocked & (n < m)
            n += picked[:, j]
        rest = np.cumsum(valid & ~picked, axis=1)
        chosen = picked | (valid & ~picked & (rest <= (m - n)[:, None]))
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
        taken = np.take_along_axis(chosen, order, 1)
        out[lo : lo + 512, : order.shape[1]] = np.where(taken, np.take_along_axis(part, order, 1), -1)
    return out


def _level(base: np.ndarray, members: np.ndarray, m: int) -> np.ndarray:
    """Neighbours (as vector numbers) of ``members``, which are in order of insertion."""
    n, want = len(members), 3 * LINKS
    near = np.full((n, want), -1, np.int32)
    sims = np.full((n, want), -np.inf, base.dtype)
    own = base[members]
    for lo in range(1, n, 512):
        hi = min(lo + 512, n)
        s = own[lo:hi] @ own[:hi].T
        s[np.arange(lo, hi)[:, None] <= np.arange(hi)[None, :]] = -np.inf
        c = min(want, hi - 1)
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
        near[lo:hi, :c] = np.where(value > -np.inf, members[top], -1)
        sims[lo:hi, :c] = value
    forward = _pick(base, members, near, sims, LINKS)
    place = np.full(len(base), -1)
    place[members] = np.arange(n)
    a, slot = np.nonzero(forward >= 0)
    b = place[forward[a, slot]]
    heads, tails = np.concatenate([a, b]), np.concatenate([b, a])
    value = np.einsum("ij,ij->i", own[heads], own[tails])
    order = np.lexsort((-value, heads))
    heads, tails, value = heads[order], tails[order], value[order]
    rank = np.arange(len(heads)) - np.searchsorted(heads, heads)
    width = 4 * m
    keep = rank < width
    near = np.full((n, width), -1, np.int32)
    sims = np.full((n, width), -np.inf, base.dtype)
    near[heads[keep], rank[keep]] = members[tails[keep]]
    sims[heads[keep], rank[keep]] = value[keep]
    used = max(1, int(rank[keep].max(initial=0)) + 1)
    return _pick(base, members, near[:, :used], sims[:, :used], m)


def _level_base(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose order by inner product with any query's first coordinates is that of the originals."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    most = lengths.max()
    scaled = vectors / most
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    base = np.concatenate([scaled, rest[:, None]], axis=1)
    return base.astype(np.float32) if lengths.min() * 16 > most else base


def build(vectors: np.ndarray, keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members and neighbour tables of every level, lowest first. ``keys``: a hash of each vector, for its level."""
    base = _level_base(vectors)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    draw = (mix(keys.view(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)), 8).astype(int)
    top = int(level.max())
    members = [order[level[order] >= lv] for lv in range(top + 1)]
    return members, [_level(base, own, 2 * LINKS if lv == 0 else LINKS) for lv, own in enumerate(members)]


def search(vectors: np.ndarray, members: list[np.ndarray], tables: list[np.ndarray], queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``breadth`` best vectors found for each query, best first (-1: none)."""
    n, q = len(vectors), len(queries)
    base = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
    base = base.astype(np.float32)
    asked = (queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]).astype(np.float32)
    entry = members[-1][:8]
    held = np.repeat(entry[None, :], q, 0).astype(np.int32)
    for lv in range(len(members) - 1, -1, -1):
        place = np.full(n, -1, np.int32)
        place[members[lv]] = np.arange(len(members[lv]))
        held = _beam(base, place, tables[lv], asked, held, breadth if lv == 0 else min(breadth, 24))
    good = held >= 0
    scores = np.full(held.shape, -np.inf)
    rows, cols = np.nonzero(good)
    for lo in range(0, len(rows), 65_536):
        r, c = rows[lo : lo + 65_536], cols[lo : lo + 65_536]
        scores[r, c] = np.einsum("ij,ij->i", vectors[held[r, c]], queries[r])
    return held, scores


def _beam(base: np.ndarray, place: np.ndarray, table: np.ndarray, asked: np.ndarray, start: np.ndarray, breadth: int, step: int = 8) -> np.ndarray:
    """Best-first search of all queries together: each round opens up to ``step`` of the best unopened vectors of every query.

    A place of a beam is one integer: the score's bits, turned so that the best comes first, the vector's number, and
    whether it was opened. Beams are then sorted as plain numbers, and only where something better came in.
    """
    q, n = len(asked), len(base)
    none = np.iinfo(np.int64).max
    beam = np.full((q, breadth), none)
    # One more column, seen from the start, stands for no vector (-1).
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    flat = seen.reshape(-1)
    near = np.where(table < 0, n, table).astype(np.int64)
    pairs = np.empty((2, 4096, base.shape[1]), base.dtype)

    def add(cells: np.ndarray) -> None:
        """Merge candidates, as places in ``flat``, into the beams."""
        cells = cells[~flat[cells]]
        cells.sort()
        cells = cells[np.diff(cells, prepend=-1) != 0]
        flat[cells] = True
        row, node = np.divmod(cells, n + 1)
        sims = np.empty(len(cells), base.dtype)
        for lo in range(0, len(cells), 4096):
            hi = min(lo + 4096, len(cells))
            a, b = pairs[:, : hi - lo]
            np.take(base, node[lo:hi], axis=0, out=a, mode="clip")
            np.take(asked, row[lo:hi], axis=0, out=b, mode="clip")
            np.einsum("ij,ij->i", a, b, out=sims[lo:hi])
        bits = sims.view(np.int32)
        bits = ~(bits ^ (bits >> 31 & 0x7FFFFFFF))
        keys = (bits.astype(np.int64) << 32) | (node << 1)
        better = keys < beam[row, -1]
        row, keys = row[better], keys[better]
        counts = np.bincount(row, minlength=q)
        who = np.flatnonzero(counts)
        if not len(who):
            return
        every = np.full((len(who), breadth + int(counts.max())), none)
        every[:, :breadth] = beam[who]
        every[np.cumsum(counts > 0)[row] - 1, breadth + np.arange(len(row)) - (counts.cumsum() - counts)[row]] = keys
        every.sort(axis=1)
        beam[who] = every[:, :breadth]

    r, c = np.nonzero(start >= 0)
    add(r * (n + 1) + start[r, c])
    live, window = np.arange(q), np.arange(3 * step)
    while len(live):
        waiting = (beam[live] & 1) == 0
        first = waiting.argmax(axis=1)
        left = waiting[np.arange(len(live)), first]
        live, first, waiting = live[left], first[left], waiting[left]
        at = first[:, None] + window
        chosen = np.take_along_axis(waiting, np.minimum(at, breadth - 1), 1) & (at < breadth)
        chosen &= np.cumsum(chosen, axis=1) <= step
        row, column = np.nonzero(chosen)
        row, column = live[row], at[row, column]
        nodes = (beam[row, column] & 0xFFFFFFFF) >> 1
        beam[row, column] |= 1
        add(((row * (n + 1))[:, None] + near[place[nodes]]).reshape(-1))
    return np.where(beam == none, -1, (beam & 0xFFFFFFFF) >> 1).astype(np.int32)


def measured_breadth(vectors: np.ndarray, members: list[np.ndarray], tables: list[np.ndarray], queries: np.ndarray, k: int) -> int:
    """The least beam of the ladder with which ``queries`` find ``RECALL`` of their ``k`` nearest in this graph.

    The nearest come from a matrix product; of equal scores those of smaller number count, as in the result.
    """
    k, most = min(k, len(vectors)), min(len(vectors), MOST_BREADTH * breadth_for(vectors.shape[1]))

    def best(nodes: np.ndarray, scores: np.ndarray) -> set[int]:
        worth = -scores.astype(np.float32)
        near = np.flatnonzero(worth <= np.partition(worth, k - 1)[k - 1]) if len(nodes) > k else np.arange(len(nodes))
        return set(nodes[near[np.lexsort((nodes[near], worth[near]))[:k]]].tolist())

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.einsum("ij,ij->i", x, x)).max()

    exact = scaled(queries) @ scaled(vectors).T
    want = [best(np.arange(len(vectors)), row) for row in exact]
    beam = max(LEAST_BREADTH, k)
    while beam < most:
        held, _ = search(vectors, members, tables, queries, beam)
        found = [len(want[i] & best(nodes[nodes >= 0], exact[i, nodes[nodes >= 0]])) for i, nodes in enumerate(held)]
        if sum(found) >= RECALL * k * len(queries):
            break
        beam = beam * 4 // 3
    return min(beam, max(most, k))


def share(k: int, parts: int) -> int:
    """How many of ``k`` vectors lie in one of ``parts`` shards that they are hashed to: four deviations above the mean."""
    mean = k / parts
    return min(k, int(np.ceil(mean + 4 * np.sqrt(mean))) + 1)


def _entries(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Distinct usable vectors with their smallest ids (k + 1 at most, as a query skips its own)."""
    usable = usable_vectors(vectors, id_col, vector_col).dropDuplicates(["id", "vector"])
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = usable.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array<double>, -0 as 0) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)


def shard_plan(counts: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """(band, first shard, shards) for every band of lengths; at most ``rows`` entries are expected in a shard."""
    out, first, held, n = [], 0, [], 0
    bands = sorted(counts, reverse=True)
    for i, band in enumerate(bands):
        held.append(band)
        n += counts[band]
        if n >= min(BAND_ROWS, rows) or i == len(bands) - 1:
            parts = -(-n // rows)
            out += [(b, first, parts) for b in held]
            first, held, n = first + parts, [], 0
    return out


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    breadth: int | None = None,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` vectors of largest inner product found for each query.
    ``breadth`` is the beam of a search; where it is not given each shard's is measured (``measured_breadth``)."""
    lengths = usable_vectors(vectors, id_col, vector_col).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    band = F.floor(F.log(F.greatest(length, F.lit(1e-300))) / float(np.log(BAND)) + 0.5).cast("int")
    entries = cut(_entries(vectors, k, id_col, vector_col).where(F.size("vector") == dims).withColumn("band", band), "entries")
    counts = {r.band: r.n for r in entries.groupBy("band").agg(F.count("*").alias("n")).collect()}
    placing = shard_plan(counts, shard_rows)
    shards = max((first + parts for _, first, parts in placing), default=1)
    placing = vectors.sparkSession.createDataFrame(placing, "band int, first int, parts int")
    asked = usable_vectors(queries, id_col, vector_col).where(F.size("vector") == dims).dropDuplicates(["id"])
    asked = cut(asked.withColumnsRenamed({"id": "query_id", "vector": "query"}), "queries")
    blocks = max(1, -(-asked.count() * 8 * dims // BLOCK_BYTES))

    def index(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Numbers follow the smallest ids, so a beam keeps the smaller id of equal scores.
        rows = rows.iloc[np.argsort([ids[0] for ids in rows["ids"]])]
        data = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        members, tables = build(data, rows["key"].to_numpy(np.int64))
        levels = [x for own, table in zip(members, tables, strict=True) for x in (len(own), table.shape[1])]
        flat = {"members": [np.concatenate(members)], "neighbours": [np.concatenate([t.ravel() for t in tables])]}
        held = {"shard": [keys[0]], "parts": [rows["parts"].iloc[0]], "dims": [data.shape[1]], "vectors": [data.tobytes()], "levels": [levels]}
        return pd.DataFrame(held | flat | {"ids": [list(rows["ids"])]})

    keyed = entries.withColumn("key", F.xxhash64("vector")).join(F.broadcast(placing), "band")
    graphs = keyed.groupBy((F.col("first") + F.pmod("key", "parts")).cast("int").alias("shard")).applyInPandas(lambda key, rows: index(key, rows), _INDEX)
    graphs = cut(graphs.repartition(shards, "shard"), "graphs")

    def look(keys: tuple, graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(block):
            g = graph.iloc[0]
            data = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dims"])
            members, tables, at, cell = [], [], 0, 0
            for size, width in zip(g["levels"][::2], g["levels"][1::2], strict=True):
                members.append(g["members"][at : at + size])
                tables.append(g["neighbours"][cell : cell + size * width].reshape(size, width))
                at, cell = at + size, cell + size * width
            beam = breadth
            if beam is None:
                # Probes are picked by a hash, so the order in which rows arrive changes nothing.
                some = np.argsort(mix(block["query_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")[:PROBES]
                probes = np.stack(block["query"].iloc[some].to_numpy()).astype(np.float64)
                beam = measured_breadth(data, members, tables, probes, share(k + 1, g["parts"]))
            beam = max(beam, k + 1)
            for lo in range(0, len(block), TOGETHER):
                part = block.iloc[lo : lo + TOGETHER]
                asked_now = np.stack(part["query"].to_numpy()).astype(np.float64)
                held, scores = search(data, members, tables, asked_now, beam)
                # k ids lie on the k + 1 best nodes (one may hold the query's own id alone), or on nodes that tie with them.
                last = min(k, scores.shape[1] - 1)
                few = (held >= 0) & (scores >= -np.partition(-scores, last, axis=1)[:, last, None])
                picked = ((nodes[own], values[own]) for nodes, values, own in zip(held, scores, few, strict=True))
                for query, (nodes, values) in zip(part["query_id"], picked, strict=True):
                    found = [
                        (-value, vec_id)
                        for node, value in zip(nodes, values, strict=True)
                        for vec_id in g["ids"][node]
                        if vec_id != query
                    ]
                    for value, vec_id in sorted(found)[:k]:
                        out["query_id"].append(query)
                        out["vec_id"].append(vec_id)
                        out["score"].append(-value)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", number).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(lambda key, a, b: look(key, a, b), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
