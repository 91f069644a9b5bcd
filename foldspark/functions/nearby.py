"""Pairs of near points of many blocks, from Arrow batches, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Cutoffs along one edge of a block.
BLOCK = 8
#: Rows that are gathered before their pairs are sought (a larger block is taken whole), and pairs compared at once.
GATHERED, COMPARED = 20_000, 500_000
#: Cubes along one edge of a block with all that may lie around it, a power of two.
_WIDE = 16


def whole_blocks(batches: Iterable[pa.RecordBatch], first: str, gathered: int = GATHERED) -> Iterator[pa.Table]:
    """The rows in tables of whole blocks. In a block's first row the column ``first`` is 1, nowhere else."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False) == 1)
        if n + len(batch) >= gathered and len(starts):
            held.append(batch.slice(0, starts[-1]))
            yield pa.Table.from_batches(held)
            batch, held, n = batch.slice(starts[-1]), [], 0
        held.append(batch)
        n += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def _ranges(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every point in the order of ``code``: places of the points in its own column of cubes that come after it, and
    in each of four neighbouring columns, as far as the next cube up and down. All pairs of neighbours are met once."""
    yield np.arange(1, len(code) + 1), np.searchsorted(code, code + 1, "right")
    for x, y in ((0, 1), (1, -1), (1, 0), (1, 1)):
        there = code + (x * _WIDE + y) * _WIDE
        yield np.searchsorted(code, there - 1, "left"), np.searchsorted(code, there + 1, "right")


def near(points: np.ndarray, block: np.ndarray, cutoff: np.ndarray, own: np.ndarray, compared: int = COMPARED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, distance) of points of one block that are nearer than the cutoff, ``compared`` or so at a time. Pairs
    of two points that are not the block's ``own`` are left out. ``block`` numbers the blocks and does not fall."""
    if not len(points):
        return
    cube = np.floor(points / cutoff[:, None]).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    rank = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(block)]))
    cube -= np.minimum.reduceat(cube, starts)[rank] - 1
    code = rank
    for c in cube.T:
        code = code * _WIDE + c
    order = np.argsort(code, kind="stable")
    code, (x, y, z), cutoff, own = code[order], points[order].T.copy(), cutoff[order], own[order]
    for lo, hi in _ranges(code):
        many = hi - lo
        upto = np.cumsum(many)
        a = done = 0
        while a < len(many):
            b = max(a + 1, int(np.searchsorted(upto, done + compared, "right")))
            left = np.repeat(np.arange(a, b), many[a:b])
            right = np.arange(done, upto[b - 1]) + np.repeat(lo[a:b] - (upto - many)[a:b], many[a:b])
            some = own[left] | own[right]
            left, right = left[some], right[some]
            d = np.sqrt((x[left] - x[right]) ** 2 + (y[left] - y[right]) ** 2 + (z[left] - z[right]) ** 2)
            close = d < cutoff[left]
            if close.any():
                yield order[left[close]], order[right[close]], d[close]
            a, done = b, int(upto[b - 1])


def near_pairs(keys: list[str], schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: keys, i, j and d of the near pairs i + 1 < j. The rows come block by block."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches, "_row"):
            given = {c: table.column(c).to_numpy() for c in ("pos", "x", "y", "z", "_cut", "_own", "_row")}
            points = np.column_stack([given[c] for c in "xyz"])
            of = table.select(keys).combine_chunks()
            for a, b, d in near(points, np.cumsum(given["_row"] == 1), given["_cut"], given["_own"]):
                i, j = np.minimum(given["pos"][a], given["pos"][b]), np.maximum(given["pos"][a], given["pos"][b])
                apart = j > i + 1
                columns = [*(of.column(k).take(pa.array(a[apart])).combine_chunks() for k in keys), pa.array(i[apart]), pa.array(j[apart]), pa.array(d[apart])]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pairs
