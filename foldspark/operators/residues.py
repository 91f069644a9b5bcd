"""From atoms to one row for each residue, and the choice of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_name, is_amino_acid, is_nucleotide
from ..schemas import K, Keys, along


def detect_chain_types(atoms: DataFrame, keys: Keys = K) -> DataFrame:
    """chain_type of every chain that has polymer residues: rna if nucleotides outnumber amino acids, else protein."""
    kept = atoms.where(F.coalesce(F.col("hetflag"), F.lit("")) != "W").select(*keys, "res_seq", "icode", "res_name").distinct()
    amino = is_amino_acid(F.col("res_name"))
    counts = kept.groupBy(*keys).agg(F.count(F.when(amino, 1)).alias("n_amino"), F.count(F.when(~amino & is_nucleotide(F.col("res_name")), 1)).alias("n_nucleotide"))
    return counts.where("n_amino + n_nucleotide > 0").select(*keys, F.when(F.col("n_nucleotide") > F.col("n_amino"), "rna").otherwise("protein").alias("chain_type"), "n_amino", "n_nucleotide")


def polymer_residues(atoms: DataFrame, types: DataFrame, keys: Keys = K) -> DataFrame:
    """Atoms of polymer residues: amino acids in protein chains, nucleotides in others; no water."""
    typed = atoms.where(F.coalesce(F.col("hetflag"), F.lit("")) != "W").join(types.select(*keys, "chain_type"), list(keys))
    fits = F.when(F.col("chain_type") == "protein", is_amino_acid(F.col("res_name"))).otherwise(is_nucleotide(F.col("res_name")))
    return typed.where(fits)


def residue_table(atoms: DataFrame, keys: Keys = K, atom_name: str = "C3'") -> DataFrame:
    """One row per residue that has the chain's representative atom: pos (from 0, in file order), res_num, res_label.

    A chain without ``atom_name`` falls back to C3' (rna) or CA (protein), or is dropped. Of alternate locations the one
    of largest occupancy counts, then the first by letter. ``atoms`` has chain_type.
    """
    whole = Window.partitionBy(*keys)
    spare = F.when(F.col("chain_type") == "protein", "CA").otherwise("C3'")
    asked = F.max((F.col("atom_name") == atom_name).cast("int")).over(whole)
    chosen = atoms.withColumn("_asked", asked).where(F.col("atom_name") == F.when(F.col("_asked") == 1, F.lit(atom_name)).otherwise(spare))
    one = Window.partitionBy(*keys, "res_seq", "icode").orderBy(F.desc("occupancy"), "altloc", "serial")
    chosen = chosen.withColumn("_one", F.row_number().over(one)).where("_one = 1")
    rows = chosen.withColumn("pos", F.row_number().over(along(keys, "serial")) - 1)
    label = F.concat(F.col("res_seq").cast("string"), F.coalesce(F.trim("icode"), F.lit("")))
    return rows.select(*keys, "pos", (F.col("pos") + 1).alias("res_num"), label.alias("res_label"), "res_name", "res_seq", "icode", "x", "y", "z", "chain_type")


def min_length_filter(residues: DataFrame, keys: Keys = K, least: int = 30) -> DataFrame:
    """Residues of chains that have at least ``least``."""
    return residues.withColumn("n_res", F.count("*").over(Window.partitionBy(*keys))).where(F.col("n_res") >= least)


def select_chains(residues: DataFrame, mode: str = "all", keys: Keys = K, structure: Keys = ("structure_id",)) -> DataFrame:
    """``all``; ``longest``: every chain of a structure's largest length; or the chains of that id."""
    if mode == "all":
        return residues
    if mode != "longest":
        return residues.where(F.col("chain_id") == mode)
    sizes = residues.groupBy(*keys).agg(F.count("*").alias("_n"))
    best = sizes.withColumn("_r", F.rank().over(Window.partitionBy(*structure).orderBy(F.desc("_n")))).where("_r = 1").select(*keys)
    return residues.join(best, list(keys), "left_semi")


def canonical_sequence(residues: DataFrame, keys: Keys = K) -> DataFrame:
    """Letters of a chain by residue number, with a dash for each missing number."""
    w = along(keys, "res_seq", "pos")
    gap = F.coalesce(F.col("res_seq") - F.lag("res_seq").over(w) - 1, F.lit(0))
    text = F.concat(F.repeat(F.lit("-"), F.greatest(gap, F.lit(0))), canonical_name(F.col("res_name")))
    rows = residues.select(*keys, "res_seq", "pos", text.alias("t"))
    parts = F.sort_array(F.collect_list(F.struct("res_seq", "pos", "t")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("sequence"))


def shift_residue_labels(residues: DataFrame, keys: Keys = K) -> DataFrame:
    """Numbers that go on by one from the number that opens the chain's first label; from 1 if there is none."""
    first = F.first("res_label").over(along(keys))
    start = F.regexp_extract(first, r"^(-?\d+)", 1).try_cast("int")
    return residues.select(*keys, "pos", (F.coalesce(start, F.lit(1)) + F.row_number().over(along(keys)) - 1).cast("int").alias("shifted"))


def ordinal_map(residues: DataFrame, keys: Keys = K) -> DataFrame:
    """1-based place of every row's label; repeated labels all get the last place."""
    return residues.select(*keys, "pos", "res_label", F.max(F.col("pos") + 1).over(Window.partitionBy(*keys, "res_label")).alias("ordinal"))
