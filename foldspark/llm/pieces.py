"""SentencePiece encoding for merge-type vocabularies with byte fallback, and decoding.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by the piece's score and then by place; the
best pair is merged and its new neighbours join the agenda, until none is left. Symbols that are no piece become bytes.
Short segments advance together, one merge of each at a time, with the agendas as columns of a matrix of pair ranks; long
ones have an agenda of their own in a heap.

No merge can cross a place whose two characters never meet inside a piece. The characters of all pieces fall into classes
that never meet (words of one script, signs, single characters), and the normalised text is cut where the class changes,
and before space marks; this gives the same ids. Segments are looked up by a 64-bit hash in a table of bounded size in each
worker, and every hit is compared with the characters that the table holds, so a hash that two segments share costs time
only. Every segment is checked when it enters the table: all new segments of a block are encoded by the sentencepiece
library too, and a difference is an error.

Edge cases: null texts are empty; empty texts have no ids; very long texts are encoded whole, in blocks of segments;
repeated rows give equal rows; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .scratch import text_batches

SPACE = "▁"
#: Segments that a worker's table holds before it is emptied, and bits of its number of slots.
CACHE, SLOT_BITS = 250_000, 19
#: Characters of the longest segment that is merged in a matrix, and columns of one matrix.
SHORT, COLUMNS = 32, 4096
#: Characters that are cut, hashed and looked up together.
BLOCK = 1 << 19
#: Segments that one text for the library holds.
CHECKED = 16


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + size), one range after another."""
    ends = sizes.cumsum()
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.held, self.n = np.empty(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(self.n + len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """The merges of one model file, and the segments met so far."""

    slot_bits = SLOT_BITS

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.get_piece_size()
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces aren't handled")
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in long):
            raise ValueError("models whose pieces hold line feeds, or the space mark after others, aren't handled")
        self.classes = self._classes(long)
        self.pieces = n
        order = {v: r for r, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self._pairs(long, order)
        #: No pair: above every rank (shifted by six bits for the place).
        self.never = np.int32(len(order) << 6)
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        self.newline = np.array(lib.encode("\n"), np.int32)
        # The decimal text of every id with a comma, as the bytes of one number.
        self.digits = np.array([int.from_bytes(f"{i},".encode(), "little") for i in range(n)], np.uint64)
        self.widths = np.array([len(str(i)) + 1 for i in range(n)])
        self._forget()

    def _classes(self, long: list[str]) -> np.ndarray:
        """A class for every character: 0 for those in no long piece, 1 for the space mark, else one that characters
        share if a chain of neighbours inside pieces leads from one to the other."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            root.setdefault(c, c)
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for piece in long:
            own = piece.lstrip(SPACE)
            for a, b in zip(own, own[1:], strict=False):
                root[find(a)] = find(b)
        out, number = np.zeros(0x110000, np.uint16), {}
        for c in root:
            out[ord(c)] = number.setdefault(find(c), len(number) + 2)
        out[ord(SPACE)] = 1
        return out

    def _pairs(self, long: list[str], order: dict[float, int]) -> None:
        """Sorted pairs of ids (left * pieces + right), and for each the rank of its score and the merged id."""
        pairs = {}
        for piece in long:
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.pieces + b] = (order[self.score[piece]], self.ids[piece])
        keys = sorted(pairs)
        self.pairs = np.array(keys, np.int64)
        self.ranks, self.joined = (np.array([pairs[p][k] for p in keys], np.int32) for k in range(2))
        # For every hash of a pair, whether some pair has it: most pairs are dismissed by one look.
        bits = max(16, len(keys).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[self._hash(self.pairs)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _forget(self) -> None:
        """Empty the table of segments: their characters and ids, where these end, and slots by hash."""
        self.held_chars, self.held_ids = Grown(np.uint32), Grown(np.int32)
        self.chars_end, self.ids_end = Grown(np.int64), Grown(np.int64)
        self.chars_end.add(np.zeros(1, np.int64))
        self.ids_end.add(np.zeros(1, np.int64))
        self.tags, self.numbers = np.zeros(1 << self.slot_bits, np.uint64), np.full(1 << self.slot_bits, -1, np.int64)

    def full(self) -> bool:
        return self.chars_end.n > CACHE

    def merge(self, text: str) -> list[int]:
        """Ids of normalised text."""
        symbols: list[str] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1:] = [-1]
        agenda: list[tuple[float, int, int, str]] = []
        score = self.score

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            if piece in score:
                heapq.heappush(agenda, (-score[piece], i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != piece or right[i] != j:
                continue
            symbols[i], symbols[j] = piece, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i], i)
            if right[i] >= 0:
                offer(i, right[i])
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                out += [known] if known is not None else [self.bytes[b] for b in s.encode()]
        return out

    def _look(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank with the place below it (``never``: no piece) and merged id of pairs of symbols (-1: none)."""
        rank, joined = np.full(len(left), self.never, np.int32), np.zeros(len(left), np.int32)
        keys = left.astype(np.int64) * self.pieces + right
        at = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[self.some[self._hash(keys[at])]]
        if len(at) and len(self.pairs):
            found = np.minimum(np.searchsorted(self.pairs, keys[at]), len(self.pairs) - 1)
            same = self.pairs[found] == keys[at]
            at, found = at[same], found[same]
            rank[at], joined[at] = (self.ranks[found] << 6) | place[at], self.joined[found]
        return rank, joined

    def merge_short(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many segments, each a column of ids of characters that ends in -1: ids one segment after another, and
        how many each has. Row c of the agenda holds the pair that starts at place c."""
        width, n = symbols.shape
        symbols = np.concatenate([symbols, np.full((1, n), -1, np.int32)]).ravel()
        place = np.repeat(np.arange(width + 1), n)
        last = width * n
        agenda, joined = self._look(symbols, np.append(symbols[n:], np.full(n, -1, np.int32)), place)
        # Row ``width`` stands for no neighbour: its symbol is -1, so pairs with it have no rank.
        right, left = np.minimum(place + 1, width) * n, np.where(place > 0, place - 1, width) * n
        rows = agenda.reshape(width + 1, n)[:width]
        column = np.arange(n)
        while len(column):
            best = rows[:, column].min(axis=0) if len(column) < n else rows.min(axis=0)
            going = best < self.never
            column, best = column[going], best[going]
            at = (best & 63).astype(np.int64) * n + column
            gone = right[at] + column
            symbols[at] = joined[at]
            symbols[gone], agenda[gone] = -1, self.never
            after, before = right[gone], left[at]
            right[at], left[after + column] = after, at - column
            for a, b in ((at, after + column), (before + column, at)):
                agenda[a], joined[a] = self._look(symbols[a], symbols[b], place[a])
            agenda[last:] = self.never
        table = symbols.reshape(width + 1, n).T
        there = table >= 0
        return table[there], there.sum(axis=1)

    def merged(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments given as one array of code points, and how many each segment has."""
        known, starts = self.chars[points], sizes.cumsum() - sizes
        plain = (sizes <= SHORT) & (np.minimum.reduceat(known, starts) >= 0)
        counts, parts = np.zeros(len(sizes), np.int64), []
        # Segments of alike lengths share a matrix.
        short = np.flatnonzero(plain)[np.argsort(sizes[plain], kind="stable")]
        for lo in range(0, len(short), COLUMNS):
            own = short[lo : lo + COLUMNS]
            width = int(sizes[own].max())
            at = np.arange(width)[:, None] + starts[own]
            symbols = np.where(np.arange(width)[:, None] < sizes[own], known[np.minimum(at, len(known) - 1)], -1)
            ids, counts[own] = self.merge_short(symbols.astype(np.int32))
            parts.append((own, ids))
        for k in np.flatnonzero(~plain).tolist():
            ids = self.merge(points[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-32-le"))
            counts[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.int32)))
        out, begins = np.empty(counts.sum(), np.int32), counts.cumsum() - counts
        for own, ids in parts:
            out[spread(begins[own], counts[own])] = ids
        return out, counts

    def check(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Compare the ids of segments with the library's. A line feed, which never merges, stands before each."""
        n = len(sizes)
        texts = np.full(len(points) + n, ord("\n"), np.uint32)
        texts[np.arange(len(points)) + np.repeat(np.arange(1, n + 1), sizes)] = points
        wanted = np.full(len(ids) + n, self.newline[-1], np.int32)
        wanted[np.arange(len(ids)) + np.repeat(np.arange(1, n + 1), counts)] = ids
        text = texts.tobytes().decode("utf-32-le").replace(SPACE, " ")
        ends = np.append((sizes + 1).cumsum()[CHECKED - 1 :: CHECKED], len(text)).tolist()
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False) if a < b]
        skip = len(self.newline) - 1
        given = np.concatenate([np.array(x[skip:], np.int32) for x in self.library.encode(parts, num_threads=1)])
        if not np.array_equal(given, wanted):
            raise ValueError("the library gives other ids for the segments of " + repr(text[:1000]))

    def _learn(self, points: np.ndarray, sizes: np.ndarray) -> int:
        """Put segments into the table; the number of the first."""
        ids, counts = self.merged(points, sizes)
        self.check(points, sizes, ids, counts)
        first = self.chars_end.n - 1
        for ends, values, grown in ((self.chars_end, sizes, self.held_chars), (self.ids_end, counts, self.held_ids)):
            ends.add(grown.n + values.cumsum())
        self.held_chars.add(points)
        self.held_ids.add(ids)
        return first

    def _block(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of ``points``, and how many each has."""
        if self.full():
            self._forget()
        sizes = np.diff(np.append(starts, len(points)))
        hashes = W.ranges_hash(W.mix(points), starts, sizes)
        slot = (hashes >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        number = np.where(self.tags[slot] == hashes, self.numbers[slot], -1)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            some = missing[first]
            learnt = self._learn(points[spread(starts[some], sizes[some])], sizes[some])
            number[missing] = learnt + back
            self.tags[slot[some]], self.numbers[slot[some]] = new, learnt + np.arange(len(new))
        begins, ends = self.chars_end.held[number], self.chars_end.held[number + 1]
        same = np.array_equal(ends - begins, sizes)
        if not same or not np.array_equal(self.held_chars.held[spread(begins, sizes)], points):
            # Two segments share a hash: merge this block segment by segment.
            return self.merged(points, sizes)
        begins = self.ids_end.held[number]
        counts = self.ids_end.held[number + 1] - begins
        return self.held_ids.held[spread(begins, counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's ids begin (one entry more)."""
        texts = self.library.normalize(texts)
        ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kinds = self.classes[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)) & (kinds[:-1] != 1)
        cut[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ids, counts, lo = [], [], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
            stop = starts[hi] if hi < len(starts) else len(points)
            for held, new in zip((ids, counts), self._block(points[starts[lo] : stop], starts[lo:hi] - starts[lo]), strict=True):
                held.append(new)
            lo = hi
        upto = np.concatenate([[0], np.concatenate(counts).cumsum()])
        return np.concatenate(ids), upto[np.searchsorted(starts, ends)]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The decimal ids of every text joined by commas."""
        text = self.digits[ids].view(np.uint8)
        text = memoryview(text[text != 0])
        ends = np.concatenate([[0], self.widths[ids].cumsum()])[bounds].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The encoder of a model file; one for each worker process."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ``keep`` adds ``ids`` and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        for batch in batches:
            for row, end, _, _ in W.slices(batch.column(1)):
                part = batch.slice(row, end - row)
                ids, bounds = enc.encode([x or "" for x in part.column(1).to_pylist()])
                own = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                decoded = [enc.library.decode(x) if len(x) else "" for x in own]
                arrays = [
                    part.column(0),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in enc.decimals(ids, bounds)], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                if keep:
                    arrays += [pa.ListArray.from_arrays(bounds.astype(np.int32), ids), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return chosen.mapInArrow(run, schema + ", ids array<int>, decoded string" * keep)
