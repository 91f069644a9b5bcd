"""Text files in folders named by columns (``a=1/b=x/part-0.txt``), on a disk that the driver and all executors share.

The layout is the one of Spark's ``partitionBy``, and its text reader reads it too. Spark's writer starts two processes for
each local file and one for each folder (``chmod``), and its reader starts a task for every folder it lists; for many small
files that is most of the time. Here a task opens the files itself and lists the folders that it reads.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null or empty value; characters that a folder's name spells by number.
NOTHING = "__HIVE_DEFAULT_PARTITION__"
_SPELT = {c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]}
#: Lines handed over together, and folders that one task reads at most.
LINES, FOLDERS = 10_000, 500


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the local disk, or None if it lies elsewhere."""
    at = urlsplit(path)
    if not at.scheme:
        return path if str(spark._jsc.hadoopConfiguration().get("fs.defaultFS")).startswith("file:") else None
    return unquote(at.path) if at.scheme == "file" and "%" not in at.path else None


def folder(names: Iterable[str], values: Iterable[str | None]) -> str:
    spell = lambda x: "".join(_SPELT.get(c, c) for c in x)
    return "/".join(f"{spell(n)}={spell(v) if v else NOTHING}" for n, v in zip(names, values, strict=True))


def _value(text: str) -> str | None:
    return None if text == NOTHING else unquote(text)


def write_texts(rows: DataFrame, path: str, own: list[str], order: str) -> None:
    """``value`` of the rows as lines, a file for each ``own``, sorted by ``order``. ``path`` is new. Files are written
    beside, in a hidden folder; only when all are there are the outer folders moved to ``path``, and after a failure
    nothing is left. Of two attempts at a task the last one's file stays, with the same lines."""
    os.makedirs(path)
    aside = f"{path}/_temporary-{uuid.uuid4().hex}"
    os.mkdir(aside)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, mine, files = None, None, f".{uuid.uuid4().hex}", 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(f"{at}/{mine}", f"{at}/part-0.txt")

        last = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in own]
            for key, line in zip(zip(*columns, strict=True), batch.column("value").to_pylist(), strict=True):
                if out is None or key != last:
                    close()
                    last, at, files = key, f"{aside}/{folder(own, key)}", files + 1
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/{mine}", "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                out.write(f"{line or ''}\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    try:
        text = rows.select(*(F.col(k).cast("string").alias(k) for k in own), *([order] if order not in own else []), "value")
        # Empty and null name one folder.
        text = text.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in own})
        text.repartition(*own).sortWithinPartitions(*own, order).select(*own, "value").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
        for name in os.listdir(aside):
            os.rename(f"{aside}/{name}", f"{path}/{name}")
        os.rmdir(aside)
        open(f"{path}/_SUCCESS", "w").close()
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise


def read_texts(spark: SparkSession, path: str, own: list[str]) -> DataFrame:
    """``value`` of all lines, and ``own`` (as text) from the folders' names. The outer folders are dealt to tasks."""
    schema = ", ".join([*(f"`{k}` string" for k in own), "value string"])
    outer = sorted(e.name for e in os.scandir(path) if e.is_dir() and "=" in e.name and e.name[0] not in "._")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[str | None], list[str]]] = []
        n = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([v for key, lines in held for v in [key[c]] * len(lines)], pa.string()) for c in range(len(own))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x for _, lines in held for x in lines], pa.string())], names=[*own, "value"])

        for names in batches:
            for name in names.column("name").to_pylist():
                for at, _, files in os.walk(f"{path}/{name}"):
                    found = {unquote(k): v for k, _, v in (part.partition("=") for part in os.path.relpath(at, path).split("/"))}
                    for file in sorted(f for f in files if f[0] not in "._"):
                        with open(f"{at}/{file}", "rb") as lines:
                            rest = lines.read().splitlines()
                        for a in range(0, len(rest), LINES):
                            held.append(([_value(found[k]) for k in own], [x.decode("utf-8", "replace") for x in rest[a : a + LINES]]))
                            n += len(held[-1][1])
                            if n >= LINES:
                                yield batch()
                                held, n = [], 0
        if held:
            yield batch()

    tasks = max(1, min(len(outer), max(spark.sparkContext.defaultParallelism, -(-len(outer) // FOLDERS))))
    names = spark.createDataFrame(spark.sparkContext.parallelize([(x,) for x in outer], tasks), "name string")
    return names.mapInArrow(read, schema)
