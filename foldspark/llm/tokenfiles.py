"""Token ids as ORC files that can be read stripe by stripe.

Texts are dealt out by ranges of ids, sorted and encoded in one task a range, and written by Spark's ORC writer: columns of
integers are run-length encoded, every ``STRIDE`` rows have an entry in the row index with the least and largest id, and
ids have Bloom filters. A row carries the number of its range and the number of ids before it in the range, so a reader
needs only the ranges' totals to know where a document begins: any stripe can be read by itself, in parallel. ``look_up``
reads the stripes and row groups that may hold given documents.

Edge cases: a null text is empty, and an empty one has the end id alone; rows without id come first; rows with one id are
in order of their place in the table, each with its own start (which of several equal rows is which does not matter);
very long texts are encoded whole, in blocks of segments; other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as W
from .bytepairs import byte_encoder
from .scratch import new_path, text_batches

SCHEMA = "doc_id bigint, range int, before bigint, n_tokens bigint, ids array<int>"
#: Bytes of text of one range (a file of about half as many), rows of one entry of the row index, bytes of a stripe.
RANGE_BYTES, STRIDE, STRIPE_BYTES = 64_000_000, 1000, 16_000_000
#: Rows after which the writer looks at its stripe's size (5,000 by default, however long the rows).
ROWS_BETWEEN_CHECKS = 500


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int | None = None,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ORC files under ``path`` in ascending order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, before = byte_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, end, _, _ in W.slices(batch.column(1)):
                part = batch.slice(row, end - row)
                ids, bounds = enc.encode_with_special([x or "" for x in part.column(1).to_pylist()])
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(end - row, number, np.int32)),
                        pa.array(before + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32)),
                    ],
                    names=["doc_id", "range", "before", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    spark = docs.sparkSession
    text_batches(spark)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if ranges is None:
        total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(-(-total // RANGE_BYTES), spark.sparkContext.defaultParallelism)
    # The place of a row lets ranges end between rows of one id (or without id), however many there are.
    placed = chosen.withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("place").asc()]
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.row.index.stride": STRIDE,
        "orc.stripe.size": STRIPE_BYTES,
        "orc.rows.between.memory.checks": ROWS_BETWEEN_CHECKS,
    }
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files under ``path``, with ``start``: the number of ids in all rows before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals, before = {}, 0
    for r in rows.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect():
        totals[r["range"]], before = before, before + r["n"]
    offsets = spark.createDataFrame(list(totals.items()), "range int, earlier bigint")
    start = (F.col("before") + F.col("earlier")).alias("start")
    return rows.join(F.broadcast(offsets), "range").select("doc_id", start, "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; row groups whose range or Bloom filter excludes them are not read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of rows as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3)
            bounds = held.offsets.to_numpy() * 4
            data = memoryview(np.ascontiguousarray(held.values.to_numpy(), "<i4").tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def tokens_written_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files that are written of it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    return with_crc(read_tokens(spark, path))
