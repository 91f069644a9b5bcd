"""What leaves the library: results as JSON, selection commands, atoms by cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import format_range
from ..operators.intervals import ranges_of, ranges_with_insertions
from ..schemas import K, Keys, shuffled
from .folders import local_path, read_texts, write_texts
from .structures import atom_columns

#: Colours of the first clusters; later ones are numbered.
COLOURS = ("red", "green", "yellow", "orange", "blue", "pink", "cyan", "purple", "white", "grey", "brown", "lightblue", "lightorange", "lightpink", "gold")


def _commands(texts: DataFrame, keys: Keys, name: Column) -> DataFrame:
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("label"))
    rows = texts.withColumn("_n", number)
    colours = F.array(*(F.lit(c) for c in COLOURS))
    colour = F.when(F.col("_n") <= len(COLOURS), F.get(colours, F.col("_n") - 1)).otherwise(F.lpad(F.col("_n").cast("string"), 2, "0"))
    selection = F.when(F.col("label") == -1, F.concat(name, F.lit("_outlier"))).otherwise(F.concat(name, F.lit("_cluster_"), F.col("_n").cast("string")))
    colour = F.when(F.col("label") == -1, "grey").otherwise(colour)
    return rows.select(*keys, "label", F.concat(F.lit("select "), selection, F.lit(", res "), "ranges", F.lit("; color "), colour, F.lit(", "), selection).alias("command"))


def _texts(ranges: DataFrame, by: Keys) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("range_no", format_range(F.col("start"), F.col("end")).alias("t"))))
    return ranges.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "+").alias("ranges"))


def selection_commands(labels: DataFrame, keys: Keys = K, name: Column | None = None) -> DataFrame:
    """One command for each label, with ranges of residue labels (insertions included)."""
    own = [*keys, "label"]
    return _commands(_texts(ranges_with_insertions(labels, own), own), keys, name if name is not None else F.col("chain_id").cast("string"))


def selection_command_plain(labels: DataFrame, keys: Keys = K, name: Column | None = None) -> DataFrame:
    """The same from residue numbers."""
    own = [*keys, "label"]
    ranges = ranges_of(labels.select(*own, F.col("res_num").alias("value")), own)
    return _commands(_texts(ranges, own), keys, name if name is not None else F.col("chain_id").cast("string"))


def split_structure_by_cluster(atoms: DataFrame, labels: DataFrame, keys: Keys = K) -> DataFrame:
    """Atoms of labelled residues with their cluster; a residue in several clusters goes to the first."""
    first = labels.where("label <> -1").groupBy(*keys, "res_label").agg(F.min("label").alias("label"))
    return atoms.join(shuffled(first), [*keys, "res_label"])


def pdb_line() -> Column:
    """An atom as a line of a PDB file, inverse to ``structures.atoms_from_lines``.

    Numbers beyond their columns keep the last digits (serial and residue numbers), longer names and chains the first
    characters; a null, and a coordinate that is too long, is blank."""

    def text(name: str, width: int, right: bool = False) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.lpad(value, width, " ") if right else F.rpad(value, width, " ")

    def last(name: str, digits: int) -> Column:
        value = F.col(name).cast("int")
        fits = (value > -(10 ** (digits - 1))) & (value < 10**digits)
        return F.coalesce(F.lpad(F.when(fits, value).otherwise(value % 10 ** (digits - 1)).cast("string"), digits, " "), F.lit(" " * digits))

    def real(name: str, width: int, places: int) -> Column:
        value = F.format_string(f"%.{places}f", F.col(name).cast("double"))
        fits = F.col(name).isNotNull() & (F.length(value) <= width)
        return F.when(fits, F.lpad(value, width, " ")).otherwise(" " * width)

    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.col("atom_name"))).otherwise(F.coalesce("atom_name", F.lit("")))
    numbers = [real(c, w, p) for c, w, p in (("x", 8, 3), ("y", 8, 3), ("z", 8, 3), ("occupancy", 6, 2), ("bfactor", 6, 2))]
    return F.concat(
        text("record", 6), last("serial", 5), F.lit(" "), F.rpad(name, 4, " "), text("altloc", 1), text("res_name", 3, True),
        text("chain_id", 2, True), last("res_seq", 4), text("icode", 1), F.lit("   "), *numbers, F.lit(" " * 10), text("element", 2, True), text("charge", 2),
    )


def write_split_structures(atoms: DataFrame, path: str, keys: Keys = K) -> None:
    """One PDB text file for each structure, model, chain (``keys``) and cluster, in a folder of its own: the rows of a
    file are sorted by serial in one task, and all files are there or none. Columns of an atom that the table lacks are
    blank. On a local disk tasks open the files themselves (``folders``), elsewhere Spark's writer does."""
    own = [*keys, "label"]
    known = {"record": F.when(F.col("hetflag") == "", "ATOM").otherwise("HETATM")} if "hetflag" in atoms.columns else {"record": F.lit("ATOM")}
    names = ["record", "serial", "atom_name", "altloc", "res_name", "chain_id", "res_seq", "icode", "x", "y", "z", "occupancy", "bfactor", "element", "charge"]
    blank = {c: known.get(c, F.lit(None).cast("string")) for c in names if c not in atoms.columns}
    rows = atoms.withColumns(blank).select(*own, "serial", pdb_line().alias("value"))
    if local := local_path(rows.sparkSession, path):
        return write_texts(rows, local, own, "serial")
    rows.repartition(*own).sortWithinPartitions(*own, "serial").select(*own, "value").write.partitionBy(*own).text(path)


def read_split_structures(spark: SparkSession, path: str, keys: Keys = K, types: str = "structure_id string, model_id int, chain_id string") -> DataFrame:
    """The atoms of files that ``write_split_structures`` wrote: keys and label come from the folders."""
    schema = f"value string, {types}, label int"
    if local := local_path(spark, path):
        fields = spark.createDataFrame([], schema).schema
        lines = read_texts(spark, local, [*keys, "label"]).select("value", *(F.col(k).cast(fields[k].dataType).alias(k) for k in (*keys, "label")))
    else:
        # Without a file there are no folders to read the keys from.
        found = set(keys) <= set(spark.read.text(path).columns)
        lines = spark.read.schema(schema).text(path) if found else spark.createDataFrame([], schema)
    folders = {k: f"_{k}" for k in keys}
    lines = lines.withColumnsRenamed(folders).withColumns({"structure_id": F.lit(""), "line_no": F.lit(0)})
    atoms = atom_columns(lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")), *folders.values(), "label")
    return atoms.drop(*keys).withColumnsRenamed({v: k for k, v in folders.items()})


def result_frame(residues: DataFrame, labels: DataFrame, keys: Keys = K, scores: DataFrame | None = None, missing: DataFrame | None = None, commands: DataFrame | None = None, chain: Keys = ("structure_id", "chain_id")) -> DataFrame:
    """One nested row for each chain: data, cluster, res, res_labels, missing_res, commands, Score."""
    rows = residues.join(labels.select(*keys, "pos", "label"), [*keys, "pos"])
    ordered = F.sort_array(F.collect_list(F.struct("pos", "res_num", "res_label", "label", "x", "y", "z"))).alias("_r")
    out = rows.groupBy(*keys).agg(ordered)
    out = out.select(*keys, F.transform("_r", lambda r: F.array(r["x"], r["y"], r["z"])).alias("data"), F.col("_r.label").alias("cluster"), F.col("_r.res_num").alias("res"), F.col("_r.res_label").alias("res_labels"))
    if missing is not None:
        listed = missing.groupBy(*chain).agg(F.sort_array(F.collect_list(F.struct("ord", "res_label")))["res_label"].alias("missing_res"))
        out = out.join(listed, list(chain), "left")
    if commands is not None:
        out = out.join(commands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "command")))["command"].alias("commands")), list(keys), "left")
    if scores is not None:
        rounded = scores.select(*keys, F.struct(*(F.round(c, 3).alias(c.upper() if c != "iou" else "IoU") for c in ("csd", "iou", "ndo", "dbd"))).alias("Score"))
        out = out.join(rounded, list(keys), "left")
    return out


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.json(path)
