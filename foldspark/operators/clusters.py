"""Labels as clusters and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import K, Keys
from .intervals import format_ranges, ranges_with_insertions


def labels_to_clusters(labels: DataFrame, keys: Keys = K, keep_outliers: bool = False, member: str = "pos") -> DataFrame:
    """label and its sorted members; -1 is dropped unless ``keep_outliers``, rows without label always. Null members are
    left out."""
    rows = labels.where("label is not null" if keep_outliers else "label <> -1")
    return rows.groupBy(*keys, "label").agg(F.sort_array(F.collect_list(member)).alias("members"))


def clusters_to_labels(residues: DataFrame, clusters: DataFrame, keys: Keys = K, outliers: DataFrame | None = None) -> DataFrame:
    """Label of every residue: the last cluster that holds it, -1 where none does or ``outliers`` lists it."""
    held = clusters.select(*keys, "label", F.explode("members").alias("pos")).groupBy(*keys, "pos").agg(F.max("label").alias("label"))
    out = residues.select(*keys, "pos").join(held, [*keys, "pos"], "left")
    if outliers is not None:
        out = out.join(outliers.select(*keys, "pos", F.lit(True).alias("_out")).distinct(), [*keys, "pos"], "left")
        out = out.withColumn("label", F.when(F.col("_out").isNull(), F.col("label")))
    return out.select(*keys, "pos", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_summary(labels: DataFrame, keys: Keys = K) -> DataFrame:
    """Per label: residues, text of its ranges, and the chain's numbers of clusters and outliers."""
    own = [*keys, "label"]
    texts = format_ranges(ranges_with_insertions(labels, own), own)
    sizes = labels.groupBy(*own).agg(F.count("*").alias("residues")).join(texts, own)
    chain = Window.partitionBy(*keys)
    outlier = F.col("label") == -1
    # One row a label: the chain's numbers are sums over its few labels.
    clusters = F.count(F.when(~outlier, 1)).over(chain).alias("n_clusters")
    outliers = F.coalesce(F.sum(F.when(outlier, F.col("residues"))).over(chain), F.lit(0)).alias("n_outliers")
    return sizes.select(*own, "residues", "ranges", clusters, outliers)
