"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, and so many rows of one 64-bit key; above it a shuffled join is used.
BROADCAST_BYTES = 16_000_000
BROADCAST_ROWS = 1_000_000


#: Rows of one Arrow batch of texts. Spark's own 10,000 hold some 30 MB of web text, several times in the JVM and in
#: Python, and far more of long documents.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Set the session to batches of ``BATCH_ROWS`` rows, unless it has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. Where none is configured a local one is set, but on one machine only: a cluster's executors
    would write where nobody else can read."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _written.get()) is not None:
        held.append(path)
    return path


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are given out inside, in order, for ``delete`` when what was made of them is written."""
    held: list[str] = []
    token = _written.set(held)
    try:
        yield held
    finally:
        _written.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        held = jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(conf).delete(held, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written key table if it has at most ``rows`` rows (read off its footers); else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
