"""Runs and ranges along a chain. Every operator is one sort by the chain key and place; those that take ``places`` cut
longer chains into tasks of so many places (``scans``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import base_number, format_range
from ..schemas import K, Keys, along, before
from .scans import scanned


def _runs(rows: DataFrame, keys: Keys, breaks: Column, order: str = "pos", places: int | None = None) -> DataFrame:
    """Number the runs of each chain (from 0): a new one starts where ``breaks`` is true."""
    rows = rows.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    return scanned(rows, keys, order, places, total={"run": F.col("_break")}).withColumn("run", F.col("run").cast("int") - 1).drop("_break")


def ranges_of(values: DataFrame, keys: Keys = K, value: str = "value") -> DataFrame:
    """Maximal runs of consecutive integers: range_no (from 0), start, end. Null values are in no range."""
    seen = values.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    island = seen.withColumn("_island", F.col(value) - F.row_number().over(along(keys, value)))
    ranges = island.groupBy(*keys, "_island").agg(F.min(value).alias("start"), F.max(value).alias("end"))
    return ranges.select(*keys, (F.row_number().over(along(keys, "start")) - 1).alias("range_no"), "start", "end")


def ranges_with_insertions(labels: DataFrame, keys: Keys = K, label: str = "res_label", order: str = "pos", places: int | None = None) -> DataFrame:
    """Runs of residue labels in the given order: the number stays or grows by one. range_no, start, end (labels)."""
    rows = labels.withColumn("_n", base_number(F.col(label)))
    rows = scanned(rows, keys, order, places, lag={"_before": F.col("_n")})
    rows = _runs(rows, keys, ~(F.col("_n") - F.col("_before")).isin(0, 1), order, places)
    first, last = (F.min(F.struct(order, label)), F.max(F.struct(order, label)))
    return rows.groupBy(*keys, F.col("run").alias("range_no")).agg(first[label].alias("start"), last[label].alias("end"))


def label_runs(labels: DataFrame, keys: Keys = K, label: str = "label", places: int | None = None) -> DataFrame:
    """Maximal runs of equal labels: run (from 0), label, start, end, length. A null label is a run of its own; rows
    without a place are in no run."""
    rows = scanned(labels.select(*keys, "pos", label).where("pos is not null"), keys, "pos", places, lag={"_before": F.col(label)})
    rows = _runs(rows, keys, F.col(label) != F.col("_before"), "pos", places)
    grouped = rows.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").cast("int").alias("length"))
    return grouped


def labelled_ranges(labels: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Members of the runs of equal labels: run, label, pos. A domain residue that does not follow its predecessor by
    one is left out (its run goes on); a chain of one residue has no run. A null label is a run of its own; rows without
    a place are in no run."""
    rows = labels.select(*keys, "pos", "label").where("pos is not null")
    rows = scanned(rows, keys, "pos", places, lag={"_at": F.col("pos"), "_was": F.col("label")})
    rows = rows.withColumn("_gap", F.col("pos") - F.col("_at")).withColumn("_same", F.col("label") == F.col("_was")).drop("_at", "_was")
    if places is None:
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        counts = rows.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.count("*").alias("_n"))
        rows = rows.join(counts, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*(f"_k_{k}" for k in keys))
    rows = _runs(rows, keys, ~F.col("_same"), "pos", places)
    kept = ~F.coalesce(F.col("_same"), F.lit(False)) | (F.col("label") == -1) | (F.col("_gap") == 1)
    return rows.where((F.col("_n") > 1) & kept).select(*keys, "run", "label", "pos")


def domain_points(labels: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Places where one domain follows another directly: the first residue of the right one. Beside a null label there is
    no such place."""
    labels = scanned(labels.where("pos is not null"), keys, "pos", places, lag={"_left": F.col("label")})
    return labels.where("_left <> label and _left <> -1 and label <> -1").select(*keys, F.col("pos").alias("start"), F.col("pos").alias("end"))


def internal_linkers(labels: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Runs of label -1 that touch neither end of the chain."""
    runs = label_runs(labels, keys, places=places)
    ends = Window.partitionBy(*keys)
    runs = runs.withColumn("_last", F.max("run").over(ends))
    return runs.where("label = -1 and run > 0 and run < _last").select(*keys, "start", "end")


def split_segments_at(segments: DataFrame, points: DataFrame, keys: Keys = K) -> DataFrame:
    """Cut segments (seg, ord, element) at the elements of ``points`` that are neither first nor last of their segment;
    the element opens the new part. Adds part (from 0)."""
    own = [*keys, "seg"]
    marked = segments.join(points.select(*keys, F.col("point").alias("element"), F.lit(1).alias("_cut")).distinct(), [*keys, "element"], "left")
    inner = (F.col("ord") > F.min("ord").over(Window.partitionBy(*own))) & (F.col("ord") < F.max("ord").over(Window.partitionBy(*own)))
    marked = marked.withColumn("_cut", (F.col("_cut").isNotNull() & inner).cast("int"))
    return marked.select(*own, "ord", "element", F.sum("_cut").over(before(own, "ord")).cast("int").alias("part"))


def format_ranges(ranges: DataFrame, by: Keys, order: str = "range_no") -> DataFrame:
    """Text of the ranges of each ``by`` group: ``a-b`` or ``a``, joined by comma and blank."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), format_range(F.col("start"), F.col("end")).alias("t"))))
    return ranges.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("ranges"))


def forward_fill_labels(labels: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Every number from the first to the last res_num of a chain, with label and res_label of the last one seen."""
    one = labels.groupBy(*keys, "res_num").agg(F.max(F.struct("pos", "label", "res_label")).alias("_s"))
    bounds = labels.groupBy(*keys).agg(F.min("res_num").alias("_lo"), F.max("res_num").alias("_hi"))
    every = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("res_num"))
    filled = scanned(every.join(one, [*keys, "res_num"], "left"), keys, "res_num", places, last={"_s": F.col("_s")})
    return filled.select(*keys, "res_num", F.col("_s.label").alias("label"), F.col("_s.res_label").alias("res_label"))
