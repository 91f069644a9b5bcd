"""Readers of structure files and their annotations. Each has a form on a table of lines or texts."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_nucleotide

#: Columns of an atom line, name and half-open slice.
ATOM_COLUMNS = (
    ("record", 0, 6, "string"), ("serial", 6, 11, "int"), ("atom_name", 12, 16, "string"), ("altloc", 16, 17, "string"), ("res_name", 17, 20, "string"),
    ("chain_id", 20, 22, "string"), ("res_seq", 22, 26, "int"), ("icode", 26, 27, "string"), ("x", 30, 38, "double"), ("y", 38, 46, "double"), ("z", 46, 54, "double"),
    ("occupancy", 54, 60, "double"), ("bfactor", 60, 66, "double"), ("element", 76, 78, "string"), ("charge", 78, 80, "string"),
)
#: One letter for each secondary structure code; other codes are coil.
SS_CODES = {"H": "H", "G": "H", "I": "H", "E": "E", "B": "E"}
PAIR_LISTS = ("pairs", "pair", "basePairs", "base_pairs", "bps", "bp_list")
_ATOMS = "record string, serial int, atom_name string, altloc string, res_name string, chain_id string, res_seq int, icode string, x double, y double, z double, occupancy double, bfactor double, element string, charge string"

ATOMS_SCHEMA = f"structure_id string, model_id int, {_ATOMS}, hetflag string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """structure_id (the file's name), line_no and value of every line."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("structure_id"), "value")
    return text.select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def _slice(lo: int, hi: int) -> Column:
    return F.trim(F.substring("value", lo + 1, hi - lo))


def atoms_from_lines(lines: DataFrame) -> DataFrame:
    """ATOM and HETATM lines as atoms. model_id counts MODEL lines above (1 without any)."""
    w = Window.partitionBy("structure_id").orderBy("line_no")
    model = F.greatest(F.sum(F.col("value").startswith("MODEL").cast("int")).over(w), F.lit(1)).cast("int")
    rows = lines.withColumn("model_id", model).where(_slice(0, 6).isin("ATOM", "HETATM"))
    return atom_columns(rows, "structure_id", "model_id")


def atom_columns(lines: DataFrame, *kept: str) -> DataFrame:
    """The fields of atom lines (``value``), beside the columns ``kept``."""
    columns = [_slice(lo, hi).try_cast(kind).alias(name) if kind != "string" else _slice(lo, hi).alias(name) for name, lo, hi, kind in ATOM_COLUMNS]
    atoms = lines.select(*kept, *columns)
    het = F.when(F.col("record") != "HETATM", "").when(F.col("res_name").isin("HOH", "WAT"), "W").otherwise("H")
    return atoms.withColumn("hetflag", het)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    return atoms_from_lines(_lines(spark, path))


def _loop(lines: Iterable[str], prefix: str) -> Iterator[dict[str, str]]:
    """Rows of the loop of an mmCIF file whose columns start with ``prefix``, by column name, line by line."""
    names: list[str] = []
    held: list[str] = []
    on = False
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(prefix):
            names.append(line.split()[0][len(prefix) :])
            on = True
        elif on and (line.startswith(("#", "loop_", "data_")) or line.startswith("_")):
            break
        elif on:
            held += [a or b or c for a, b, c in re.findall(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"([^\"]*)\"(?=\s|$)|(\S+)", line)]
            while len(held) >= len(names):
                yield dict(zip(names, held, strict=False))
                held = held[len(names) :]


def mmcif_atoms(lines: Iterable[str]) -> Iterator[tuple]:
    """Atoms of the lines of an mmCIF file, in the order of ``ATOMS_SCHEMA`` without the structure."""

    def number(v: str | None, kind=float):
        try:
            return kind(v)
        except (TypeError, ValueError):
            return None

    blank = {".", "?", None}
    for r in _loop(lines, "_atom_site."):
        get = lambda *keys: next((r[k] for k in keys if r.get(k) not in blank), "")  # noqa: B023, E731
        name = get("auth_comp_id", "label_comp_id")
        record = get("group_PDB")
        het = "" if record != "HETATM" else "W" if name in ("HOH", "WAT") else "H"
        yield (
            number(get("pdbx_PDB_model_num"), int) or 1, record, number(get("id"), int), get("auth_atom_id", "label_atom_id"), get("label_alt_id"), name,
            get("auth_asym_id", "label_asym_id"), number(get("auth_seq_id", "label_seq_id"), int), get("pdbx_PDB_ins_code"), *(number(get(f"Cartn_{c}")) for c in "xyz"),
            number(get("occupancy")), number(get("B_iso_or_equiv")), get("type_symbol"), get("pdbx_formal_charge"), het,
        )


def atoms_from_mmcif(texts: DataFrame) -> DataFrame:
    """Atoms of mmCIF texts (structure_id, value)."""
    names = [f.split()[0] for f in ATOMS_SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, text in zip(batch["structure_id"], batch["value"], strict=True):
                atoms = ((sid, *a) for a in mmcif_atoms(io.StringIO(text)))
                while rows := list(islice(atoms, 10_000)):
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("model_id", "serial", "res_seq")})

    return texts.select("structure_id", "value").mapInPandas(run, ATOMS_SCHEMA)


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("structure_id")
    return atoms_from_mmcif(spark.read.text(path, wholetext=True).select(name, "value"))


def unobserved_from_mmcif(texts: DataFrame) -> DataFrame:
    """structure_id, chain_id, res_name, res_label, ord of the residues that an mmCIF text lists as unobserved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sid, text in zip(batch["structure_id"], batch["value"], strict=True):
                for ord_, r in enumerate(_loop(io.StringIO(text), "_pdbx_unobs_or_zero_occ_residues.")):
                    icode = r.get("PDB_ins_code", "?")
                    rows.append((sid, r.get("auth_asym_id"), r.get("auth_comp_id"), r.get("auth_seq_id", "") + ("" if icode in ".?" else icode), ord_))
            yield pd.DataFrame(rows, columns=["structure_id", "chain_id", "res_name", "res_label", "ord"])

    return texts.select("structure_id", "value").mapInPandas(run, "structure_id string, chain_id string, res_name string, res_label string, ord int")


def missing_from_lines(lines: DataFrame) -> DataFrame:
    """Residues listed under the missing-residue header of a structure, to the first line that is no remark."""
    w = Window.partitionBy("structure_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("value").rlike(r"^REMARK 465\s+M\s+RES\s+C\s+SSSEQI")
    rows = lines.withColumn("_in", F.coalesce(F.max(head.cast("int")).over(w), F.lit(0)))
    rows = rows.withColumn("_out", F.coalesce(F.max(F.when((F.col("_in") == 1) & ~F.col("value").startswith("REMARK"), 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    name, chain, label = _slice(15, 18), _slice(19, 20), _slice(22, 27)
    rows = rows.where("_in = 1 and _out = 0").where((F.length(F.trim("value")) >= 20) & (chain != ""))
    rows = rows.where(is_nucleotide(name) | (F.length(name) == 3))
    return rows.select("structure_id", chain.alias("chain_id"), name.alias("res_name"), label.alias("res_label"), (F.row_number().over(Window.partitionBy("structure_id").orderBy("line_no")) - 1).alias("ord"))


def ss_from_lines(lines: DataFrame) -> DataFrame:
    """Assignments of secondary structure: structure_id, chain_id, res_name, res_label, ss, ord."""
    code = _slice(24, 25)
    letter = F.coalesce(F.create_map(*(F.lit(x) for kv in SS_CODES.items() for x in kv))[code], F.lit("C"))
    rows = lines.where(F.col("value").startswith("ASG"))
    return rows.select("structure_id", _slice(9, 10).alias("chain_id"), _slice(5, 8).alias("res_name"), _slice(10, 15).alias("res_label"), letter.alias("ss"), F.col("line_no").alias("ord"))


def paired_residues(documents: DataFrame) -> DataFrame:
    """structure_id, chain_id, res_label of the residues that a base-pair JSON document pairs."""
    end = "string"
    pair = "struct<nt1:{0},nt2:{0},res1:{0},res2:{0},i:{0},j:{0},ntA:{0},ntB:{0}>".format(end)
    schema = f"struct<{','.join(f'{name}:array<{pair}>' for name in PAIR_LISTS)},stems:array<struct<pairs:array<{pair}>>>>"
    parsed = documents.select("structure_id", F.from_json("value", schema).alias("d"))
    lists = [F.coalesce(F.col(f"d.{name}"), F.array().cast(f"array<{pair}>")) for name in PAIR_LISTS]
    stems = F.coalesce(F.flatten(F.transform("d.stems", lambda s: F.coalesce(s["pairs"], F.array().cast(f"array<{pair}>")))), F.array().cast(f"array<{pair}>"))
    pairs = parsed.select("structure_id", F.explode(F.concat(*lists, stems)).alias("p"))
    first = F.coalesce("p.nt1", "p.res1", "p.i", "p.ntA")
    second = F.coalesce("p.nt2", "p.res2", "p.j", "p.ntB")
    ends = pairs.select("structure_id", F.explode(F.array(first, second)).alias("e")).where("e is not null")
    text = F.coalesce(F.get_json_object("e", "$.nt_id"), F.get_json_object("e", "$.id"), F.get_json_object("e", "$.name"), F.col("e"))
    chain = F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", 1)).otherwise(F.substring_index(text, ":", 1))
    label = F.element_at(F.regexp_extract_all(text, F.lit(r"(-?\d+[A-Za-z]?)"), 1), -1)
    return ends.select("structure_id", chain.alias("chain_id"), label.alias("res_label")).where("res_label is not null").distinct()


def paired_flags(residues: DataFrame, documents: DataFrame) -> DataFrame:
    """Residues with ss H where they are paired, else C."""
    pairs = paired_residues(documents).withColumn("_p", F.lit(True))
    return residues.join(pairs, ["structure_id", "chain_id", "res_label"], "left").withColumn("ss", F.when(F.col("_p"), "H").otherwise("C")).drop("_p")
