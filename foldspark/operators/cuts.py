"""Where a chain may be cut in two, and the best cut by local modularity.

A split of a whole fragment into a block B and the rest needs only L_B (edge weight inside B) and d_B (weighted degree of
B): Q = (m - d_B + 2 L_B)/m - g [((2m - d_B)/2m)^2 + (d_B/2m)^2], with m the fragment's edge weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import K, Keys, along, before, shuffled
from .graph import ends

#: Shortest piece of protein chains and of others, and shortest middle of a discontinuous split.
PROTEIN_MIN, OTHER_MIN, MIN_GAP = 10, 30, 30
COIL = ("C", "T", "S")


def block_modularity(inside: Column, degree: Column, total: Column, resolution: float = 1.0) -> Column:
    rest = (2 * total - degree) / (2 * total)
    return (total - degree + 2 * inside) / total - resolution * (rest * rest + F.pow(degree / (2 * total), F.lit(2.0)))


def cut_candidates(ss: DataFrame, keys: Keys = K, boundary_only: bool = False, coil: tuple[str, ...] = COIL, coil_step: int = 6, gap_label: str | None = None) -> DataFrame:
    """Places k (cut between k - 1 and k): changes of structure, every ``coil_step``-th place of a coil stretch, and
    with ``gap_label`` residues whose number does not follow the one before."""
    w = along(keys)
    coiled = F.col("ss").isin(*coil)
    rows = ss.select(*keys, "pos", "ss", *([gap_label] if gap_label else [])).withColumn("_coil", coiled)
    change = F.col("ss") != F.lag("ss").over(w)
    allowed = change
    if not boundary_only and coil_step:
        start = F.when(F.col("_coil") & ~F.coalesce(F.lag("_coil").over(w), F.lit(False)), F.greatest(F.col("pos"), F.lit(1)))
        rows = rows.withColumn("_start", start).withColumn("_start", F.last("_start", ignorenulls=True).over(before(keys)))
        allowed = allowed | (F.col("_coil") & (F.col("pos") >= F.col("_start")) & ((F.col("pos") - F.col("_start")) % coil_step == 0))
    if gap_label:
        number = F.col(gap_label).try_cast("int")
        allowed = allowed | F.coalesce(number != F.lag(number).over(w) + 1, F.lit(False))
    return rows.withColumn("_allowed", allowed).where((F.col("pos") >= 1) & F.col("_allowed")).select(*keys, F.col("pos").alias("k"))


def _suffixes(edges: DataFrame, sizes: DataFrame, keys: Keys) -> DataFrame:
    """For every place: weight of edges inside the suffix from it on, its weighted degree, and the chain's total."""
    starts = edges.select(*keys, F.col("i").alias("pos"), F.col("weight").alias("w"), F.col("weight").alias("d"))
    stops = edges.select(*keys, F.col("j").alias("pos"), F.lit(0.0).alias("w"), F.col("weight").alias("d"))
    every = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), F.lit(0.0).alias("w"), F.lit(0.0).alias("d"))
    per = starts.unionByName(stops).unionByName(every).groupBy(*keys, "pos").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    back = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return per.select(*keys, "pos", F.sum("w").over(back).alias("inside"), F.sum("d").over(back).alias("degree"), F.sum("w").over(whole).alias("m"), F.count("*").over(whole).cast("int").alias("n"))


def best_continuous_cut(edges: DataFrame, sizes: DataFrame, keys: Keys = K, min_len: int | Column = PROTEIN_MIN, resolution: float = 1.0, cuts: DataFrame | None = None) -> DataFrame:
    """Best cut of every chain into two pieces of at least ``min_len``: k (last place of the left piece) and q.

    ``sizes`` has n residues of every chain; ``min_len`` may be one of the keys. With ``cuts`` (k, first place of the right piece) only those are tried.
    First k on ties (q to nine digits). Chains that are too short or have no edge give no row.
    """
    suffix = _suffixes(edges, sizes, keys).where((F.col("m") > 0) & (F.col("pos") >= min_len) & (F.col("pos") <= F.col("n") - min_len))
    if cuts is not None:
        suffix = suffix.join(shuffled(cuts.select(*keys, F.col("k").alias("pos")).distinct()), [*keys, "pos"], "left_semi")
    scored = suffix.select(*keys, (F.col("pos") - 1).alias("k"), F.round(block_modularity(F.col("inside"), F.col("degree"), F.col("m"), resolution), 9).alias("q"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("q", (-F.col("k")).alias("_k"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._k")).alias("k"), F.col("_b.q").alias("q"))


def _inside(edges: DataFrame, tried: DataFrame, keys: Keys) -> DataFrame:
    """t, v, inside: the weight of the edges (i, j) with i > t and j <= v, for every pair in ``tried``.

    i > t holds at exactly one binary place: there i has 1, t has 0, and all higher places agree. Edges and pairs are
    sent to such places, a logarithm of the chain's length each, and one sort by j sums the edges up to each v. So a
    chain costs E log n rows, in as many groups as it has places, whatever the number of pairs.
    """
    at, side = F.col("at"), F.col("side")
    bit = lambda k: (F.floor(at / F.pow(F.lit(2.0), k)).cast("int") % 2 == side) & (F.pow(F.lit(2.0), k) < F.col("n"))
    level = F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), bit)).alias("level")
    ins = edges.join(shuffled(tried.select(*keys, "n").distinct()), list(keys)).select(*keys, "n", F.col("i").alias("at"), F.col("j").alias("upto"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("t"), "weight")
    asks = tried.select(*keys, "n", F.col("t").alias("at"), F.col("v").alias("upto"), F.lit(0).alias("side"), "t", F.lit(0.0).alias("weight"))
    rows = ins.unionByName(asks).select(*keys, "upto", "side", "t", "weight", "at", level)
    rows = rows.withColumn("node", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("int"))
    w = Window.partitionBy(*keys, "level", "node").orderBy("upto", F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("inside", F.sum("weight").over(w)).where("side = 0")
    return summed.groupBy(*keys, "t", F.col("upto").alias("v")).agg(F.sum("inside").alias("inside"))


def best_discontinuous_cut(edges: DataFrame, sizes: DataFrame, keys: Keys = K, min_len: int | Column = PROTEIN_MIN, min_gap: int = MIN_GAP, resolution: float = 1.0) -> DataFrame:
    """Best middle piece [t + 1, v] closed by a contact (t, v): t, v, q. First (t, v) on ties (q to nine digits). Chains
    without such a contact give no row."""
    degree = ends(edges, keys).groupBy(*keys, "pos").agg(F.sum("weight").alias("d"))
    prefix = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).join(shuffled(degree), [*keys, "pos"], "left")
    prefix = prefix.select(*keys, "pos", F.sum(F.coalesce("d", F.lit(0.0))).over(before(keys)).alias("upto"))
    total = edges.groupBy(*keys).agg(F.sum("weight").alias("m"))
    middle = F.col("v") - F.col("t")
    min_len = F.lit(min_len) if isinstance(min_len, int) else min_len
    tried = edges.select(*keys, F.col("i").alias("t"), F.col("j").alias("v")).join(shuffled(sizes.select(*keys, "n")), list(keys))
    last = F.col("n") - min_len
    tried = tried.where((F.col("t") >= min_len - 1) & (F.col("t") <= last - 1) & (F.col("v") + 1 > F.col("t") + F.greatest(F.lit(min_gap), min_len + 1)) & (F.col("v") + 1 <= last) & (middle >= min_len) & (F.col("n") - middle >= min_len))
    at = prefix.withColumnRenamed("pos", "t").withColumnRenamed("upto", "upto_t")
    to = prefix.withColumnRenamed("pos", "v").withColumnRenamed("upto", "upto_v")
    scored = tried.join(shuffled(_inside(edges, tried, keys)), [*keys, "t", "v"]).join(shuffled(total), list(keys)).join(shuffled(at), [*keys, "t"]).join(shuffled(to), [*keys, "v"])
    q = block_modularity(F.col("inside"), F.col("upto_v") - F.col("upto_t"), F.col("m"), resolution)
    best = scored.select(*keys, "t", "v", F.round(q, 9).alias("q")).groupBy(*keys).agg(F.max(F.struct("q", (-F.col("t")).alias("_t"), (-F.col("v")).alias("_v"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._t")).alias("t"), (-F.col("_b._v")).alias("v"), F.col("_b.q").alias("q"))
