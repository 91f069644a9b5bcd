"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of the test items is a possible seed. One pass over all texts counts in how many documents each
   occurs (partial counts are summed by a shuffle on the n-gram).
2. An item keeps the seeds whose count is at most the median over its own seeds, and all that occur in at most
   ``rare`` documents. The choice is relative to the item, so a passage planted in very many documents keeps its seeds.
3. A second pass joins passages to items on those seeds. Hits of one item that lie close together form a window of the
   text, which is aligned with the item word by word: match 2, mismatch -1, gap -1, best local score. The score is
   divided by the score of an exact copy; edited and paraphrased copies lose little. A copy needs a share of
   ``threshold`` and the score of ``LEAST_WORDS`` aligned words: the share asked for rises as items get shorter, and
   items of ``LEAST_WORDS`` words or fewer are found as exact copies only.

A window reaches as far to both sides of its seeds as the gaps of any alignment that can reach the share asked for, so
the best alignment that holds a seed is always found, however the item's words are spread. Windows without enough of the
item's words are dismissed (a score is at most that of its matches). Windows are aligned together up to ``CELLS`` words,
row by row: memory is that of the window, time that of item times window.

The items are joined as a hash table in the tasks, so they are handled in parts of at most ``PART_CHARS`` characters,
one part after another however large the benchmark is; every part reads the texts twice, and they are never shuffled.

Edge cases: null and empty texts or items match nothing, and empty tables give empty results; an item of fewer than ``n``
words is one seed of all its words, found where a text holds exactly these words in a row, unless more than ``rare``
documents do: so short a phrase is common language then, and no sign of a copy (``rare`` None: no item is left out and all
seeds are kept). Repeated rows give repeated rows, ties between windows go to the earliest. Null ids are carried, and
columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .scratch import cut, text_batches

#: Characters of test items that one pass holds in memory, in the driver and in each task.
PART_CHARS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that a copy has in common with its item at least, or all words of a shorter item.
LEAST_WORDS = 8
#: Words of all windows that are aligned together.
CELLS = 1 << 20
_HITS = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"


class Items:
    """A part of the benchmark: word hashes of every item and a sorted seed table (n-gram, item, place in the item)."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.ids = [r[0] for r in rows]
        data, offsets = W.text_bytes(pa.array([r[1] or "" for r in rows], pa.string()))
        w = W.words(data[: offsets[-1]], offsets)
        self.words = np.split(w.hashes, w.rows[1:-1]) if rows else []
        grams, items, places = [], [], []
        for size in range(1, n + 1):
            values, at = _grams(w, size)
            for i, words in enumerate(self.words):
                if len(words) >= n and size == n or len(words) == size < n:
                    own = values[at[i] : at[i + 1]]
                    grams.append(own)
                    items.append(np.full(len(own), i))
                    places.append(np.arange(len(own)))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.items = np.concatenate(items)[order] if len(order) else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if len(order) else np.zeros(0, np.int64)
        self.sizes = sorted({min(len(x), n) for x in self.words if len(x)})
        self.filter()

    def filter(self) -> None:
        """A bit for the low part of every seed, so that most n-grams of a text are dismissed by one look."""
        self.bits = 20
        self.low = np.zeros(1 << self.bits, bool)
        self.low[(self.grams & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def keep(self, counts: dict[int, int], rare: int | None) -> None:
        """Drop the seeds that are common for their item, and common items of fewer than ``n`` words."""
        if rare is None:
            return
        n = np.array([counts.get(int(g), 0) for g in self.grams.view(np.int64)], np.int64)
        keep = n <= rare
        for i in range(len(self.ids)):
            own = np.flatnonzero(self.items == i) if len(self.ids) < 64 else self._own(i)
            if len(own) and len(self.words[i]) >= self.n:
                keep[own] |= n[own] <= np.median(n[own])
        self.grams, self.items, self.places = self.grams[keep], self.items[keep], self.places[keep]
        self.filter()

    def _own(self, i: int) -> np.ndarray:
        if not hasattr(self, "_order"):
            self._order = np.argsort(self.items, kind="stable")
            self._bounds = np.searchsorted(self.items[self._order], np.arange(len(self.ids) + 1))
        return self._order[self._bounds[i] : self._bounds[i + 1]]

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Places in ``values`` that hold a seed."""
        at = np.flatnonzero(self.low[(values & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        if not len(self.grams) or not len(at):
            return at[:0]
        found = np.searchsorted(self.grams, values[at])
        return at[self.grams[np.minimum(found, len(self.grams) - 1)] == values[at]]


def _grams(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of texts that have ``size`` words at least; shorter texts have none."""
    count = np.diff(w.rows)
    values, at = W.shingles(w, size)
    long = count >= size
    keep = np.repeat(long, np.diff(at))
    bounds = np.zeros(len(at), np.int64)
    np.cumsum(np.diff(at) * long, out=bounds[1:])
    return values[keep], bounds


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each (item, window) pair and the window's place after the last aligned word.

    All pairs advance together: one numpy step for each word of the longest item. Gaps along the window are closed by a
    running maximum, which is exact for a gap cost linear in length.
    """
    k = len(items)
    rows, cols = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((k, rows), np.uint64), np.zeros((k, cols), np.uint64)
    in_a, in_b = np.zeros((k, rows), bool), np.zeros((k, cols), bool)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], in_a[i, : len(x)], b[i, : len(y)], in_b[i, : len(y)] = x, True, y, True
    best, end = np.zeros(k, np.int32), np.zeros(k, np.int64)
    above = np.zeros((k, cols + 1), np.int32)
    slope = np.arange(cols + 1, dtype=np.int32) * GAP
    for r in range(rows):
        same = (b == a[:, r : r + 1]) & in_b & in_a[:, r : r + 1]
        now = np.zeros_like(above)
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), above[:, 1:] + GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - slope, axis=1) + slope
        top = now.argmax(axis=1)
        score = now[np.arange(k), top]
        better = (score > best) & in_a[:, r]
        best[better], end[better] = score[better], top[better]
        above = now
    return best, end


def _match(items: Items, doc: np.ndarray, values: dict[int, np.ndarray], threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, word after the last) of the items found in one text, best window of each."""
    found: dict[int, list[int]] = {}
    for values_of in values.values():
        for at in items.hits(values_of):
            lo = np.searchsorted(items.grams, values_of[at], "left")
            hi = np.searchsorted(items.grams, values_of[at], "right")
            for j in range(lo, hi):
                found.setdefault(int(items.items[j]), []).append(int(at) - int(items.places[j]))
    tasks = []
    for i, starts in found.items():
        size = len(items.words[i])
        asked = _asked(size, threshold)
        slack = int(MATCH * size * (1 - asked)) // -GAP
        wide = 8 * size + 2 * slack
        lo = hi = None
        for start in sorted(set(starts)):
            if lo is None or start - slack > hi or start - lo > wide:
                if lo is not None:  # a new window overlaps the last
                    tasks.append((i, lo, hi))
                lo = start - slack
            hi = start + size + slack
        tasks.append((i, lo, hi))
    # A score is at most that of all words of the item that the window has.
    tasks = [(i, max(lo, 0), min(hi, len(doc))) for i, lo, hi in tasks]
    tasks = [t for t in tasks if _shared(items.words[t[0]], doc[t[1] : t[2]]) >= _asked(len(items.words[t[0]]), threshold)]
    out: dict[int, tuple[float, int, int]] = {}
    for part in _together(tasks, items):
        scores, ends = align([items.words[i] for i, _, _ in part], [doc[lo:hi] for _, lo, hi in part])
        for (i, lo, _), score, end in zip(part, scores, ends, strict=True):
            size = len(items.words[i])
            share = float(score) / (MATCH * size)
            if share >= _asked(size, threshold) and share > out.get(i, (0.0,))[0]:
                out[i] = (share, max(lo, lo + int(end) - size), lo + int(end))
    return [(i, *x) for i, x in sorted(out.items())]


def _asked(size: int, threshold: float) -> float:
    """The share of an exact copy's score that a copy of an item needs."""
    return max(threshold, min(LEAST_WORDS, size) / size)


def _shared(item: np.ndarray, window: np.ndarray) -> float:
    """The share of the item's words that occur in the window."""
    return float(np.isin(item, window).mean())


def _together(tasks: list[tuple[int, int, int]], items: Items) -> Iterator[list[tuple[int, int, int]]]:
    """Windows (item, first word, word after the last) in lists that are padded to ``CELLS`` words at most."""
    held, widest = [], 0
    for i, lo, hi in tasks:
        widest = max(widest, hi - lo, len(items.words[i]))
        if held and (len(held) + 1) * widest > CELLS:
            yield held
            held, widest = [], max(hi - lo, len(items.words[i]))
        held.append((i, lo, hi))
    if held:
        yield held


def parts(benchmark: DataFrame, id_col: str, text_col: str, chars: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in lists of about ``chars`` characters, split by a hash of the row."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + total // chars
    for p in range(count):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == p)
        yield [(r.id, r.text) for r in own.orderBy("id", "text").collect()]


def prepared(
    docs: DataFrame, benchmark: DataFrame, n: int, rare: int | None, text_col: str, item_id: str, item_text: str
) -> Iterator[Broadcast]:
    """The items of each part with the seeds that they keep, broadcast; ``docs`` is counted for each part."""
    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).cast("string").alias("text"))
    for rows in parts(benchmark, item_id, item_text):
        items = Items(rows, n)

        def count(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = []
                for row, _, data, offsets in W.slices(batch.column(0)):
                    w = W.words(data, offsets)
                    for size in items.sizes:
                        values, at = _grams(w, size)
                        hit = items.hits(values)
                        doc = np.searchsorted(at, hit, "right") - 1
                        if len(hit):
                            pairs = np.stack([doc.astype(np.uint64) + np.uint64(row), values[hit]])
                            grams.append(np.unique(pairs, axis=1)[1])
                every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
                found, times = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["gram", "n"])

        counts = chosen.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        items.keep({r.gram: r.n for r in counts.collect()}, rare)
        yield docs.sparkSession.sparkContext.broadcast(items)


def matches(items: Items, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, word after the last) of the items found in the texts of ``column``."""
    for row, _, data, offsets in W.slices(column):
        w = W.words(data, offsets)
        grams = {size: _grams(w, size) for size in items.sizes}
        hit = {int(d) for values, at in grams.values() for d in np.searchsorted(at, items.hits(values), "right") - 1}
        for d in sorted(hit):
            own = {size: values[at[d] : at[d + 1]] for size, (values, at) in grams.items()}
            for found in _match(items, w.hashes[w.rows[d] : w.rows[d + 1]], own, threshold):
                yield row + d, *found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 3,
    threshold: float = 0.4,
    rare: int | None = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, score (1 for an exact copy), and the words of the text where the match lies."""
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for held in prepared(docs, benchmark, n, rare, text_col, item_id, item_text):

        def match(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                found = [
                    (batch.column(0)[row].as_py(), items.ids[i], *where)
                    for row, i, *where in matches(items, batch.column(1), threshold)
                ]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "score", "start_word", "end_word"])

        found = chosen.mapInArrow(match, _HITS)
        out = found if out is None else out.unionByName(found)
    return cut(out, "contaminated")


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 3,
    threshold: float = 0.4,
    rare: int | None = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; each row is judged by its own text, whatever its id. Between
    two parts of the benchmark the rows that are left are written to the shared folder."""
    place = docs.columns.index(text_col)
    out = None
    for held in prepared(docs, benchmark, n, rare, text_col, item_id, item_text):

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in matches(held.value, batch.column(place), threshold)]] = False
                yield batch.filter(pa.array(keep))

        out = (docs if out is None else cut(out, "clean")).mapInArrow(clean, docs.schema)
    return out
