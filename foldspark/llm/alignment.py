"""Alignment of the tokens that two vocabularies make of the same text.

Both token sequences cover the same bytes. The union of both arrays of token ends cuts a text into elementary intervals;
each interval lies in one token of either side, so it is one overlap, and where it ends tokens of both sides, a group
closes. All tokens of a group's one side are linked with all of the other. Whole slices of texts are aligned at once: texts
end on both sides, so no group crosses from one text to the next.

Counts of linked id pairs cover all documents. Documents stay in blocks (an Arrow batch at most), each a row of a written
table with its distinct pairs and how many of its documents hold each; pairs are summed over blocks, and the sums go
back to the blocks, so the rows that are shuffled are pairs of blocks, not of documents or occurrences. A group in which
one side's ends never meet the other's is expanded over its distinct ids, with their numbers.

Edge cases: null and empty texts, and texts whose tokens do not give the text's bytes again (such as those with U+2581,
which reads back as a space), have no tokens: zeros and an empty string. Repeated rows count one by one; rows without id
are aligned like others; other columns are ignored. An empty table gives an empty result. Very long texts are aligned
whole, in one slice each: memory is some 60 bytes for a byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as W
from .bytepairs import byte_encoder, byte_names
from .pieces import SPACE, encoder, spread
from .scratch import cut, text_batches

#: Bytes of texts that are aligned together, and links of a group above which it is expanded over its distinct ids.
BLOCK_BYTES, DIRECT = 1 << 21, 64
BLOCK = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, bounds array<int>, which array<int>, times array<bigint>, pairs array<bigint>, docs array<int>"
)
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Vocabulary:
    """The bytes and the decimal names of all tokens of one side."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = np.array([int.from_bytes(str(i).encode(), "little") for i in range(len(tokens))], np.uint64)
        self.widths = np.array([len(str(i)) for i in range(len(tokens))], np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.starts[ids], self.sizes[ids])]


class Aligner:
    """Encoders and token bytes of both sides."""

    def __init__(self, byte_level: str, pieces: str):
        self.encode_a, self.encode_b = byte_encoder(byte_level).encode, encoder(pieces).encode
        library, byte = byte_encoder(byte_level).library, byte_names()
        names = [library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))]
        special = library.get_added_tokens_decoder()
        self.a = Vocabulary([b"" if i in special else bytes(byte[c] for c in t) for i, t in enumerate(names)])
        lib = encoder(pieces).library
        self.b = Vocabulary([
            bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i)
            else b"" if lib.is_control(i) or lib.is_unknown(i) else lib.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(lib.get_piece_size())
        ])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bounds of both sides; texts whose bytes either side changes get no ids."""
        wanted = [(" " + x).encode() for x in texts]
        sides = []
        for ids, bounds, names in (
            (*self.encode_a([" " + x if x else "" for x in texts]), self.a), (*self.encode_b(texts), self.b)
        ):
            upto = np.concatenate([[0], names.sizes[ids].cumsum()])[bounds]
            data = memoryview(names.bytes_of(ids))
            same = [data[a:b] == x for a, b, x in zip(upto, upto[1:], wanted, strict=False)]
            sides.append((ids, bounds, np.array(same, bool)))
        good = sides[0][2] & sides[1][2] & np.array([bool(x) for x in texts], bool)
        out = []
        for ids, bounds, _ in sides:
            counts = np.diff(bounds)
            out += [ids[np.repeat(good, counts)], np.concatenate([[0], (counts * good).cumsum()])]
        return tuple(out)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each worker process."""
    key = (byte_level, pieces)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides, by elementary intervals."""
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
    group = shared.cumsum() - shared
    of_a, of_b = np.empty(len(ends_a), np.int64), np.empty(len(ends_b), np.int64)
    of_a[own_a], of_b[own_b] = group, group
    return of_a, of_b


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def products(ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (text * base**2 + a * base + b) of the linked pairs, and how many links each stands for. ``text``
    has the text of every group."""
    n = len(text)
    in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    large = in_a * in_b > DIRECT
    keys, times = [], []
    plain, start_b = ~large[of_a], in_b.cumsum() - in_b
    left, own = ids_a[plain].astype(np.int64), of_a[plain]
    right = ids_b[spread(start_b[own], in_b[own])]
    key, count = np.unique((np.repeat(text[own] * base + left, in_b[own])) * base + right, return_counts=True)
    keys.append(key)
    times.append(count)
    if large.any():
        (ka, ca), (kb, cb) = (
            summed(of[large[of]] * base + ids[large[of]], np.ones(int(large[of].sum()), np.int64))
            for ids, of in ((ids_a, of_a), (ids_b, of_b))
        )
        many = np.bincount(kb // base, minlength=n)
        first = many.cumsum() - many
        own = ka // base
        lo, sizes = 0, many[own]
        upto = sizes.cumsum()
        while lo < len(ka):
            # Some four million products at a time.
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - sizes[lo] + (1 << 22))))
            at = spread(first[own[lo:hi]], sizes[lo:hi])
            key = np.repeat(text[own[lo:hi]] * base + ka[lo:hi] % base, sizes[lo:hi]) * base + kb[at] % base
            key, count = summed(key, np.repeat(ca[lo:hi], sizes[lo:hi]) * cb[at])
            keys.append(key)
            times.append(count)
            lo = hi
    return summed(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])


def written(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, n: int) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of ``n`` groups, and where each group's text ends."""
    in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    upto_a, upto_b = in_a.cumsum(), in_b.cumsum()
    word, width = np.empty(len(ids_a) + len(ids_b), np.uint64), np.empty(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)) + (upto_b - in_b)[of_a], np.arange(len(ids_b)) + upto_a[of_b]
    for ids, names, at, last, sign in ((ids_a, a, at_a, upto_a - 1, "|"), (ids_b, b, at_b, upto_b - 1, ";")):
        mark = np.full(len(ids), ord(","), np.uint64)
        mark[last] = ord(sign)
        word[at] = names.names[ids] | (mark << (names.widths[ids] * 8).astype(np.uint64))
        width[at] = names.widths[ids] + 1
    data = word.view(np.uint8)
    return memoryview(data[data != 0]), width.cumsum()[at_b[upto_b - 1]]


def blocks(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """A row of ``BLOCK`` for every slice of texts."""
    both, number = aligner(byte_level, pieces), TaskContext.get().partitionId() << 32
    base = max(len(both.a.sizes), len(both.b.sizes))
    for batch in batches:
        for row, end, _, _ in W.slices(batch.column(1), BLOCK_BYTES):
            texts = [x or "" for x in batch.column(1).slice(row, end - row).to_pylist()]
            ids_a, bounds_a, ids_b, bounds_b = both.tokens(texts)
            of_a, of_b = groups(both.a.sizes[ids_a].cumsum(), both.b.sizes[ids_b].cumsum())
            n = int(of_a[-1]) + 1 if len(of_a) else 0
            # Where each text's groups begin.
            upto = np.append(of_a, n)[bounds_a]
            text = np.repeat(np.arange(len(texts)), np.diff(upto))
            keys, times = products(ids_a, of_a, ids_b, of_b, text, base)
            names = [""] * len(texts)
            if n:
                data, ends = written(both.a, both.b, ids_a, of_a, ids_b, of_b, n)
                ends = np.concatenate([[0], ends])[upto].tolist()
                names = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]
            bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * base**2)
            links = np.concatenate([[0], times.cumsum()])
            pairs, which, docs = np.unique(keys % base**2, return_inverse=True, return_counts=True)
            numbers = [np.diff(bounds_a), np.diff(bounds_b), np.diff(upto), links[bounds[1:]] - links[bounds[:-1]]]
            columns = [
                batch.column(0).slice(row, end - row), *map(pa.array, numbers), pa.array(names, pa.string()),
                *(pa.array(x.astype(np.int32)) for x in (bounds, which)), pa.array(times), pa.array(pairs), pa.array(docs.astype(np.int32)),
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            fields = [f.strip().split(" ")[0] for f in BLOCK.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists], names=fields)
            number += 1


def scored(block: pa.Table, counts: pa.Table) -> pa.Table:
    """Rows of ``COLUMNS`` for the texts of a block, given the corpus-wide counts of its pairs."""
    held = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
    order = np.argsort(counts.column("pair").to_numpy())
    which, times, bounds = (held[c].to_numpy() for c in ("which", "times", "bounds"))
    count, best = (counts.column(c).to_numpy()[order][which] * times for c in ("count", "best"))
    columns = {c: held[c] for c in COLUMNS if c in held}
    for name, value in (("n_best", best), ("count_sum", count)):
        upto = np.concatenate([[0], value.cumsum()])
        columns[name] = pa.array((upto[bounds[1:]] - upto[bounds[:-1]]).astype(np.int64))
    return pa.table({c: columns[c] for c in COLUMNS})


def aligned_tokens(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    import tokenizers

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(chosen.mapInArrow(lambda batches: blocks(batches, byte_level, pieces), BLOCK), "blocks")
    held = rows.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    total = held.groupBy("pair").agg(F.sum("n").alias("count"))
    base = len_of(tokenizers.Tokenizer.from_file(byte_level).get_vocab_size(with_added_tokens=True), pieces)
    most = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / base)))
    total = total.withColumn("best", (F.col("count") == most).cast("int"))
    counts = held.join(total, "pair").select("block", "pair", "count", "best")
    types = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    # Both sides stem from one table; the cogroup needs columns of their own.
    texts = rows.select(*(F.col(c).alias(c) for c in rows.columns if c not in ("pairs", "docs")))
    return texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(scored, types)


def len_of(first: int, pieces: str) -> int:
    """The size of the larger vocabulary: the base of pair numbers."""
    import sentencepiece

    return max(first, sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size())
