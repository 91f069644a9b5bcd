"""The data source ``structures``: atoms of many structure files.

    files.register(spark)
    spark.read.format("structures").load(folder)

Files are packed into partitions of about ``bytes`` bytes, however small each is, and read line by line; the model's
number is carried along, and atoms leave in Arrow batches, so no file is ever held whole. Every task reads the files by
their address (anything that ``pyarrow.fs`` opens, compressed or not): the folder must be one that all executors see.
``kind`` is ``pdb`` or ``mmcif``; without it the name decides (``.cif`` and ``.mmcif`` are mmCIF).

A file's structure is its name without the last suffix, or the folder ``structure_id=...`` that it lies in. Lines that are
no atoms are skipped; fields that are no numbers are null; an empty file has no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from threading import Lock
from urllib.parse import unquote
from weakref import WeakSet

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .structures import ATOM_COLUMNS, ATOMS_SCHEMA, mmcif_atoms

#: Bytes of files in one partition, and atoms in one Arrow batch.
PARTITION_BYTES, BATCH_ATOMS = 64_000_000, 10_000
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = [tuple(f.strip().split(" ")) for f in ATOMS_SCHEMA.split(",")]
_KINDS = dict(_FIELDS)


@dataclass
class Files(InputPartition):
    """Files of one partition: (path, structure, kind)."""

    files: list[tuple[str, str, str]]


def packed(sizes: Iterable[tuple[str, int]], limit: int) -> list[list[str]]:
    """Names in order, in lists of about ``limit`` bytes; a larger file is alone."""
    out: list[list[str]] = []
    total = 0
    for name, size in sizes:
        if not out or total + size > limit:
            out.append([])
            total = 0
        out[-1].append(name)
        total += size
    return out


def number(text: str, kind: type) -> int | float | None:
    try:
        return kind(text)
    except ValueError:
        return None


def pdb_atoms(lines: Iterable[str]) -> Iterator[tuple]:
    """Atoms of the lines of a PDB file, in the order of ``ATOMS_SCHEMA`` without the structure."""
    model = 0
    slices = [(lo, hi, {"int": int, "double": float}.get(kind)) for _, lo, hi, kind in ATOM_COLUMNS]
    for line in lines:
        if line.startswith("MODEL"):
            model += 1
        record = line[:6].strip()
        if record in ("ATOM", "HETATM"):
            line = line.rstrip("\r\n")
            values = [line[lo:hi].strip(" ") if kind is None else number(line[lo:hi].strip(), kind) for lo, hi, kind in slices]
            name = values[4]
            yield max(model, 1), *values, "" if record != "HETATM" else "W" if name in ("HOH", "WAT") else "H"


class StructureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kind = options.get("kind")
        self.limit = int(options.get("bytes", PARTITION_BYTES))

    def _named(self, path: str) -> tuple[str, str, str]:
        folder = re.search(r"(?:^|/)structure_id=([^/]+)/", path)
        name = re.sub(r"\.(gz|bz2|zst)$", "", path.rsplit("/", 1)[-1])
        kind = self.kind or ("mmcif" if re.search(r"\.(mm)?cif$", name, re.IGNORECASE) else "pdb")
        return path, unquote(folder[1]) if folder else re.sub(r"\.[^.]*$", "", name), kind

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name[:1] not in "._")
        return [Files([self._named(p) for p in names]) for names in packed(files, self.limit)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        for path, structure, kind in partition.files:
            with io.TextIOWrapper(system.open_input_stream(path), "utf-8", errors="replace") as lines:
                for atom in (mmcif_atoms if kind == "mmcif" else pdb_atoms)(lines):
                    rows.append((structure, *atom))
                    if len(rows) == BATCH_ATOMS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, _FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _FIELDS])


class StructureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return ATOMS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StructureReader(dict(self.options))


_known: WeakSet[SparkSession] = WeakSet()
_register = Lock()


def register(spark: SparkSession) -> None:
    """Make the format known to a session, once, whichever threads ask."""
    with _register:
        if spark not in _known:
            spark.dataSource.register(StructureFiles)
            _known.add(spark)


def read_structures(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Atoms of all structure files under ``path``."""
    register(spark)
    reader = spark.read.format("structures")
    return (reader.option("kind", kind) if kind else reader).load(path)
