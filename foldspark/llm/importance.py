"""Importance resampling towards a target distribution over hashed word n-grams.

One scan of a document keeps the running zlib states of the runs that started at the last ``n`` words: every new word
extends each state by a space and the word and starts one of its own, and all states of the ring are features (the CRC of
the run's bytes), so no run is ever put together. Buckets of all documents are written once; their counts, and those of
the target's texts, give every bucket a gain, and a document's weight is the mean gain of its features. Adding Gumbel
noise of the id and taking the highest scores draws without replacement in proportion to exp(weight / 1000).

Scores are integers within some 100,000 values (logarithms of doubles), so the rank of a row is the number of rows with
higher scores, which a table of counts by score gives, plus its place among those of its own score. Rows of one score and
id are numbered by the part of the table that holds them, so no task gets all of them.

Edge cases: null and empty texts have no words, no features and weight 0; a row without id has the noise of the empty id
and comes before others on ties; repeated rows are drawn one by one; very long texts are scanned whole; empty tables give
empty results, and an empty target gives every bucket a gain by the documents' counts alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordhash as W
from .scratch import cut, text_batches

#: Signs of words (digits, letters, everything outside ASCII); A-Z count as a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return data.translate(_PLAIN).split()


def states(words: list[bytes], n: int) -> Iterator[int]:
    """CRCs of all runs of 1 to ``n`` words, joined by one space, in one scan."""
    ring: deque[int] = deque(maxlen=n)
    for word in words:
        if len(ring) == n:
            ring.popleft()
        if ring:
            spaced = b" " + word
            for k, state in enumerate(ring):
                ring[k] = zlib.crc32(spaced, state)
        ring.append(zlib.crc32(word))
        yield from ring


def bucketed(docs: DataFrame, n: int, buckets: int, text_col: str, id_col: str | None) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.slices(batch.column(1)):
                data, counts, found = data.tobytes(), [], []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    words = words_of(data[a:b])
                    counts.append(len(words))
                    found.append((np.fromiter(states(words, n), np.uint32) % buckets).astype(np.int32))
                bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(bounds, np.concatenate(found))
                columns = [batch.column(0).slice(row, end - row), pa.array(counts, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    text_batches(docs.sparkSession)
    key = F.col(id_col).cast("bigint") if id_col else F.lit(None).cast("bigint")
    chosen = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of ``rows`` each bucket has: every task counts its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of every bucket, both with one count more."""
    some, wanted, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (some + n) / ((s + 1.0) * (wanted + n))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of rows of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            bounds = held.offsets.to_numpy()
            upto = np.concatenate([[0], gain[held.values.to_numpy()].cumsum()])
            counts = np.diff(bounds).astype(np.int64)
            weight = (upto[bounds[1:]] - upto[bounds[:-1]]) // np.maximum(counts, 1)
            score = weight + np.array([noise(x, seed) for x in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(weight), pa.array(score)],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return rows.mapInArrow(run, schema)


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``rows`` with the rank of those drawn."""
    spark = rows.sparkSession
    able = F.col("n_words") >= least_words
    # One row a score: bounded by the range of scores, not by the rows.
    counts = {r.score: r.n for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    wanted, above, offsets = percent * sum(counts.values()) // 100, 0, []
    for score in sorted(counts, reverse=True):
        if above >= wanted:
            break
        offsets.append((score, above))
        above += counts[score]
    lowest = offsets[-1][0] if offsets else None
    high = able & (F.col("score") >= F.lit(lowest).cast("bigint"))
    high = F.coalesce(high, F.lit(False))
    drawn = rows.where(high).withColumn("part", F.shiftright("row", 33))
    own = ["score", "doc_id", "part"]
    sizes = drawn.groupBy(*own).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    offsets = spark.createDataFrame(offsets, "score bigint, above bigint")
    sizes = sizes.join(F.broadcast(offsets), "score")
    inside = F.row_number().over(Window.partitionBy(*own).orderBy("row"))
    drawn = drawn.withColumn("inside", inside).alias("d").join(
        sizes.alias("s"), (F.col("d.score") == F.col("s.score")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.part") == F.col("s.part"))
    )
    rank = F.col("above") + F.col("earlier") + F.col("inside")
    drawn = drawn.select("d.doc_id", "n_features", "weight", "d.score", F.when(rank <= wanted, rank).alias("rank"))
    rest = rows.where(~high).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    percent: int = 10,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; ``rank`` (from 1) where it is one of the ``percent`` per
    cent, rounded down, of the rows with ``least_words`` words or more that score highest, ties to smaller ids."""
    rows = cut(bucketed(docs, n, buckets, text_col, id_col), "buckets")
    wanted = bucket_counts(bucketed(target, n, buckets, target_col, None), buckets)
    gain = gains(bucket_counts(rows, buckets), wanted)
    scored = cut(weighed(rows, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    return ranked(scored, least_words, percent)
