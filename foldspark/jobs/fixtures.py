"""Chains made from the given tables: residues of the event stream and of line items, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["chain_id"]


def _lattice(rows: DataFrame, jitter) -> DataFrame:
    """Places of compact blocks of 20 residues, 30 apart; the fourth block lies beside the first."""
    block, k = F.floor(F.col("pos") / 20).cast("int"), F.col("pos") % 20
    rows = rows.withColumn("_b", block).withColumn("_k", k)
    x = 30.0 * (F.col("_b") % 3) + 3.8 * (F.col("_k") % 3) + 0.05 * jitter
    y = 11.4 * F.floor(F.col("_b") / 3) + 3.8 * (F.floor(F.col("_k") / 3).cast("int") % 3)
    return rows.withColumns({"x": x.cast("double"), "y": y.cast("double"), "z": (3.8 * F.floor(F.col("_k") / 9)).cast("double"), "true_label": (F.col("_b") % 3).cast("int")})


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain per user, one residue per event, with labels, residue labels and names derived from the place."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("chain_id"), "ts", "event_id", "value", "event_type", "props")
    pos = (F.row_number().over(Window.partitionBy("chain_id").orderBy("ts", "event_id")) - 1).cast("int")
    rows = _lattice(events.withColumn("pos", pos), F.col("value") - F.floor("value"))
    p = F.col("pos")
    res_seq = F.floor(p * 4 / 5).cast("int")
    icode = F.when((p > 0) & (F.floor(p * 4 / 5) == F.floor((p - 1) * 4 / 5)), "A").otherwise("")
    names = F.create_map(*(F.lit(v) for kv in {"click": "A", "view": "C", "purchase": "G", "error": "U", "signup": "GLY"}.items() for v in kv))
    return rows.select(
        "chain_id", "pos", (p + 1).alias("res_num"), "x", "y", "z", "true_label", "event_type", "props",
        F.when(F.col("event_type").isin("error", "click"), "H").when(F.col("event_type") == "view", "E").otherwise("C").alias("ss"),
        F.when((p % 20).isin(18, 19), -1).otherwise(F.floor((p + 3) / 20).cast("int") % 3).alias("pred"),
        F.when(p % 20 == 0, -1).otherwise(F.col("true_label")).alias("truth"),
        res_seq.alias("res_seq"), icode.alias("icode"), F.concat(res_seq.cast("string"), icode).alias("res_label"),
        F.coalesce(names[F.col("event_type")], F.lit("GLY")).alias("res_name"),
    )


def with_gaps(rows: DataFrame) -> DataFrame:
    """All ``residues``, numbered with two numbers left out before every 17th."""
    skipped = (2 * F.floor(F.col("pos") / 17)).cast("int")
    number = F.col("res_seq") + skipped
    return rows.withColumns({
        "pos": F.col("pos") + skipped, "res_num": F.col("res_num") + skipped,
        "res_seq": number, "res_label": F.concat(number.cast("string"), "icode"),
    })


def long_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain per supplier, of about 600 residues."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity")
    items = items.select(F.col("l_suppkey").alias("chain_id"), *order, "l_discount")
    pos = (F.row_number().over(Window.partitionBy("chain_id").orderBy(*order)) - 1).cast("int")
    rows = items.withColumn("pos", pos)
    return _lattice(rows, F.col("l_discount")).select("chain_id", "pos", "x", "y", "z", "true_label")


def atoms(rows: DataFrame) -> DataFrame:
    """Atoms of ``residues``: a representative and a second atom each, one water for every ten residues."""
    amino = F.col("res_name") == "GLY"
    main, second = F.when(amino, "CA").otherwise("C3'"), F.when(amino, "N").otherwise("P")
    gone = F.col("pos") % 23 == 7
    names = F.array_compact(F.array(F.when(~gone, F.struct(F.lit(0).alias("o"), main.alias("n"), F.col("res_name").alias("r"), F.lit("").alias("h"))), F.struct(F.lit(1).alias("o"), second.alias("n"), F.col("res_name").alias("r"), F.lit("").alias("h")), F.when(F.col("pos") % 10 == 9, F.struct(F.lit(2).alias("o"), F.lit("O").alias("n"), F.lit("HOH").alias("r"), F.lit("W").alias("h")))))
    out = rows.select("chain_id", "pos", F.explode(names).alias("a"), "res_seq", "icode", "res_label", "x", "y", "z")
    shift = F.col("a.o") * 0.5
    return out.select(
        F.lit("s").alias("structure_id"), F.lit(1).alias("model_id"), "chain_id", (F.col("pos") * 3 + F.col("a.o") + 1).alias("serial"), F.col("a.n").alias("atom_name"), F.lit("").alias("altloc"),
        F.col("a.r").alias("res_name"), (F.col("res_seq") + F.when(F.col("a.o") == 2, 5000).otherwise(0)).alias("res_seq"), "icode", (F.col("x") + shift).alias("x"), "y", "z", F.lit(1.0).alias("occupancy"), F.col("a.h").alias("hetflag"),
    )
