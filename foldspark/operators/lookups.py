"""Look-ups in intervals and the joins that attach annotations to residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_amino_acid, is_nucleotide
from ..schemas import K, Keys
from ..session import checkpoint_dir
from .scans import scanned


def parse_partition(partitions: DataFrame, keys: Keys = K, partition: str = "partition") -> DataFrame:
    """``1-30+60-90;31-59`` as rows label (place of the domain, from 0), start, end."""
    domains = partitions.select(*keys, F.posexplode(F.split(F.regexp_replace(partition, " ", ""), ";")).alias("label", "_d"))
    parts = domains.where("_d <> ''").select(*keys, "label", F.explode(F.split("_d", "\\+")).alias("_s"))
    bounds = F.split("_s", "-")
    return parts.select(*keys, "label", bounds[0].cast("int").alias("start"), F.coalesce(F.get(bounds, F.lit(1)), bounds[0]).cast("int").alias("end"))


def labels_from_partition(residues: DataFrame, ranges: DataFrame, keys: Keys = K) -> DataFrame:
    """Label of the first domain that holds each residue (by res_num), else -1.

    Ranges are cut to the chain's own numbers and laid out as places, so residues meet them by an equi-join.
    """
    bounds = residues.groupBy(*keys).agg(F.min("res_num").alias("_lo"), F.max("res_num").alias("_hi"))
    held = ranges.select(*keys, "label", "start", "end").join(bounds, list(keys))
    held = held.select(*keys, "label", F.greatest("start", "_lo").alias("a"), F.least("end", "_hi").alias("b")).where("a <= b")
    held = held.select(*keys, "label", F.explode(F.sequence("a", "b")).alias("res_num")).groupBy(*keys, "res_num").agg(F.min("label").alias("label"))
    found = residues.select(*keys, "pos", "res_num").join(held, [*keys, "res_num"], "left")
    return found.select(*keys, "pos", F.coalesce("label", F.lit(-1)).alias("label"))


def _asof(values: DataFrame, marks: DataFrame, keys: Keys, mark: str, forward: bool, places: int | None = None) -> DataFrame:
    """Nearest mark at or below (at or above) every value, by one sort of both tables together."""
    both = values.select(*keys, F.col("value").alias("at"), F.lit(None).cast("int").alias("mark"), F.lit(1).alias("kind"))
    both = both.unionByName(marks.select(*keys, F.col(mark).alias("at"), F.col(mark).alias("mark"), F.lit(0).alias("kind")))
    found = scanned(both, keys, "at", places, then=["kind"], backward=forward, last={"found": F.col("mark")})
    return found.where("kind = 1").select(*keys, F.col("at").alias("value"), "found")


def asof_bounds_below(values: DataFrame, ranges: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Largest start and, apart from it, largest end at or below each value; -1 if none. Values are distinct."""
    start = _asof(values, ranges, keys, "start", False, places).withColumnRenamed("found", "start")
    end = _asof(values, ranges, keys, "end", False, places).withColumnRenamed("found", "end")
    return start.join(end, [*keys, "value"]).select(*keys, "value", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"))


def asof_bounds_above(values: DataFrame, ranges: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Smallest start and smallest end at or above each value; the value itself if none. Values are distinct."""
    start = _asof(values, ranges, keys, "start", True, places).withColumnRenamed("found", "start")
    end = _asof(values, ranges, keys, "end", True, places).withColumnRenamed("found", "end")
    return start.join(end, [*keys, "value"]).select(*keys, "value", F.coalesce("start", "value").alias("start"), F.coalesce("end", "value").alias("end"))


def asof_floor(values: DataFrame, elements: DataFrame, keys: Keys = K, places: int | None = None) -> DataFrame:
    """Largest element at or below each value, with the place (idx) where it occurs first; (null, -1) if none."""
    first = elements.groupBy(*keys, "element").agg(F.min("idx").alias("idx"))
    both = values.select(*keys, F.col("value").alias("at"), F.lit(None).cast("struct<element:int,idx:int>").alias("s"), F.lit(1).alias("kind"))
    both = both.unionByName(first.select(*keys, F.col("element").alias("at"), F.struct("element", "idx").alias("s"), F.lit(0).alias("kind")))
    found = scanned(both, keys, "at", places, then=["kind"], last={"_s": F.col("s")}).withColumn("s", F.col("_s")).where("kind = 1")
    return found.select(*keys, F.col("at").alias("value"), F.col("s.element").alias("element"), F.coalesce("s.idx", F.lit(-1)).alias("idx"))


def segment_of(values: DataFrame, segments: DataFrame, keys: Keys = K, order: str | bool | None = None) -> DataFrame:
    """First segment (seg, ord, element) that holds each value; with ``order`` False or "first" only as its first item,
    with any other as its last. -1 if none."""
    held = segments
    if order is not None:
        edge = F.min("ord") if order in (False, "first") else F.max("ord")
        held = held.withColumn("_edge", edge.over(Window.partitionBy(*keys, "seg"))).where("ord = _edge")
    first = held.groupBy(*keys, F.col("element").alias("value")).agg(F.min("seg").alias("seg"))
    return values.select(*keys, "value").join(first, [*keys, "value"], "left").select(*keys, "value", F.coalesce("seg", F.lit(-1)).alias("seg"))


def attach_ss(residues: DataFrame, ss: DataFrame, keys: Keys = K, fill: str = "C") -> DataFrame:
    """Residues with the code of their label; the last of repeated assignments (by ``ord``) wins."""
    one = ss.groupBy(*keys, "res_label").agg(F.max_by("ss", "ord").alias("ss"))
    return residues.join(one, [*keys, "res_label"], "left").withColumn("ss", F.coalesce("ss", F.lit(fill)))


def align_ss(ss: Column, n: Column, fill: str = "C") -> Column:
    """An array of codes cut or filled to ``n``."""
    return F.concat(F.slice(ss, F.lit(1), n), F.array_repeat(F.lit(fill), F.greatest(n - F.size(ss), F.lit(0)).cast("int")))


def missing_residues(annotated: DataFrame, atoms: DataFrame, chain: Keys = ("structure_id", "chain_id"), model: Keys = ("model_id",)) -> DataFrame:
    """Annotated labels in file order, then numbers between the first and last seen that no polymer residue has; ord.

    Numbers missing in any model count. The first of equal labels is kept.
    """
    own = [*chain, *model]
    seen = atoms.where((F.coalesce("hetflag", F.lit("")) != "W") & (is_amino_acid(F.col("res_name")) | is_nucleotide(F.col("res_name")))).select(*own, "res_seq").distinct()
    bounds = seen.groupBy(*own).agg(F.min("res_seq").alias("lo"), F.max("res_seq").alias("hi"))
    gaps = bounds.select(*own, F.explode(F.sequence("lo", "hi")).alias("res_seq")).join(seen, [*own, "res_seq"], "left_anti")
    gaps = gaps.select(*chain, F.col("res_seq").cast("string").alias("res_label"), F.lit(1).alias("_part"), F.col("res_seq").alias("_o")).distinct()
    every = annotated.select(*chain, "res_label", F.lit(0).alias("_part"), F.col("ord").alias("_o")).unionByName(gaps)
    one = every.groupBy(*chain, "res_label").agg(F.min(F.struct("_part", "_o")).alias("_m"))
    return one.select(*chain, "res_label", (F.row_number().over(Window.partitionBy(*chain).orderBy("_m", "res_label")) - 1).alias("ord"))


def _stars(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node connected with each node that has an edge (u, v); edges go down, u > v.

    Alternates large-star and small-star steps until no edge moves, however many rounds that takes; a path needs about
    the logarithm of its length. Every round is checkpointed.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        linked = e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))

    def done(e: DataFrame) -> bool:
        """Whether every node has one edge down, or only edges up."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()

    now = edges.distinct().checkpoint()
    while not done(now):
        now = small(large(now).where("u > v").distinct()).where("u > v").distinct().checkpoint()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def overlap_components(clusters: DataFrame, keys: Keys = K, drop_isolated: bool = True) -> DataFrame:
    """Members of clusters merged while they share members: component (smallest cluster number), member.

    ``clusters`` has cluster and member. Clusters are linked to the smallest that holds the same member, and the links
    are followed until they stand still; each round is checkpointed to the folder of ``spark.checkpoint.dir``.
    """
    checkpoint_dir(clusters.sparkSession)
    rows = clusters.select(*keys, "cluster", "member").distinct()
    rows = rows.withColumn("node", F.struct(*keys, "cluster")).withColumn("_m", F.struct(*keys, "member")).checkpoint()
    links = rows.join(rows.groupBy("_m").agg(F.min("node").alias("v")), "_m").where("node > v").select(F.col("node").alias("u"), "v")
    rows = rows.join(_stars(links), "node", "inner" if drop_isolated else "left")
    return rows.select(*keys, F.coalesce("comp.cluster", "cluster").alias("component"), "member").distinct()
