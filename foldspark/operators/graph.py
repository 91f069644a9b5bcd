"""Contact graph of a chain as an edge table (i < j), and what is counted on it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import contact_weight, distance
from ..functions.nearby import BLOCK, near_pairs
from ..schemas import K, Keys, along, shuffled

#: Contact distance of protein chains and of others.
PROTEIN_CUTOFF, OTHER_CUTOFF = 7.5, 15.0


def cutoff_for(chain_type: Column) -> Column:
    return F.when(chain_type == "protein", PROTEIN_CUTOFF).otherwise(OTHER_CUTOFF)


def _near(points: DataFrame, keys: Keys) -> DataFrame:
    """i, j, d of the residues i + 1 < j of a chain that are nearer than ``_cut``.

    A chain is cut into cubic blocks, eight cutoffs wide. A residue goes to its own block, and as a guest to those of the
    neighbours on one side (two blocks that touch see each other once) that it is near to. The blocks are sorted, and
    numpy finds the pairs of many of them together (``functions.nearby``): what is moved and held grows with residues,
    not with pairs, and nothing is broadcast.
    """
    at = {c: F.col(c) / F.col("_cut") for c in "xyz"}
    given = points.where(reduce(lambda a, b: a & b, [F.col("pos").isNotNull(), F.col("_cut") > 0, *(F.abs(c) < float("inf") for c in at.values())]))
    given = given.withColumns({f"_b{c}": F.floor(v / BLOCK) for c, v in at.items()}).withColumns({f"_r{c}": v - F.floor(v / BLOCK) * BLOCK for c, v in at.items()})
    # A little more than a cutoff, for rounding.
    reach = 1 + 1e-6
    touches = {-1: lambda c: F.col(f"_r{c}") <= reach, 0: lambda c: F.lit(True), 1: lambda c: F.col(f"_r{c}") >= BLOCK - reach}
    half = [(x, y, z) for x in (0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    block = lambda step: F.struct(*((F.col(f"_b{c}") + d).alias(f"_c{c}") for c, d in zip("xyz", step, strict=True)), F.lit(step == (0, 0, 0)).alias("_own"))
    seen = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a & b, [touches[d](c) for c, d in zip("xyz", step, strict=True)]), block(step)) for step in half)))
    # Null keys are equal to no other. (A filter would be moved below the shuffle, which could then not be shared.)
    seen = F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), seen)
    rows = given.select(*keys, "pos", *"xyz", "_cut", F.inline(seen))
    # The window sorts the blocks and marks where they begin; a chain that lies in one task already stays there.
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_cut", "_cx", "_cy", "_cz").orderBy("pos")))
    rows = rows.select(*keys, "pos", *"xyz", "_cut", "_own", "_row")
    types = rows.schema
    out = StructType([*(types[k] for k in keys), StructField("i", types["pos"].dataType), StructField("j", types["pos"].dataType), StructField("d", DoubleType())])
    return rows.mapInArrow(near_pairs(list(keys), to_arrow_schema(out)), out)


def contact_edges(residues: DataFrame, cutoff: float | Column = PROTEIN_CUTOFF, keys: Keys = K, weighted: bool = True) -> DataFrame:
    """Edges i, j, weight: neighbours in the chain, and residues nearer than ``cutoff``.

    Null coordinates have no contacts but those along the chain (weight null there).
    """
    cut = F.lit(cutoff) if isinstance(cutoff, (int, float)) else cutoff
    points = residues.select(*keys, "pos", *(F.col(c).cast("double").alias(c) for c in "xyz"), cut.cast("double").alias("_cut"))
    near = _near(points, keys)
    w = along(keys)
    chain = points.select(*keys, F.col("pos").alias("i"), F.lead("pos").over(w).alias("j"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(F.lead(c).over(w).alias(f"b{c}") for c in "xyz"))
    # The distance is asked for even where no weight is: with other columns than the near pairs need, all residues would be
    # shuffled a second time.
    chain = chain.where("j is not null").withColumn("d", distance("a", "b")).where("d is null or d >= 0").select(*keys, "i", "j", "d")
    return near.unionByName(chain).select(*keys, "i", "j", (contact_weight(F.col("d")) if weighted else F.lit(1.0)).alias("weight"))


def ends(edges: DataFrame, keys: Keys = K) -> DataFrame:
    """Each edge from both sides: pos, other, weight."""
    sides = F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("j").alias("other")), F.struct(F.col("j").alias("pos"), F.col("i").alias("other"))))
    return edges.select(*keys, sides.alias("_s"), "weight").select(*keys, "_s.pos", "_s.other", "weight")


def node_degree(edges: DataFrame, keys: Keys = K) -> DataFrame:
    """Number of neighbours and their weight. An edge without weight counts as a neighbour only; a residue that has no
    other edge has no weight."""
    return ends(edges, keys).groupBy(*keys, "pos").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def _sided(edges: DataFrame, labels: DataFrame, keys: Keys) -> DataFrame:
    """Edges with the labels of both ends (label_i, label_j)."""
    out = edges
    for end in "ij":
        out = out.join(shuffled(labels.select(*keys, F.col("pos").alias(end), F.col("label").alias(f"label_{end}"))), [*keys, end])
    return out


def bipartition_modularity(edges: DataFrame, sides: DataFrame, keys: Keys = K, resolution: float = 1.0) -> DataFrame:
    """q of the split of each chain by ``label``: sum over sides of L/m - g (d/2m)^2 over edges inside the table."""
    sided = _sided(edges, sides, keys)
    inside = F.explode(F.array(F.struct(F.col("label_i").alias("side"), F.when(F.col("label_i") == F.col("label_j"), F.col("weight")).otherwise(0.0).alias("l"), F.col("weight").alias("d")), F.struct(F.col("label_j").alias("side"), F.lit(0.0).alias("l"), F.col("weight").alias("d"))))
    per = sided.select(*keys, inside.alias("_p")).groupBy(*keys, "_p.side").agg(F.sum("_p.l").alias("l"), F.sum("_p.d").alias("d"))
    total = per.groupBy(*keys).agg((F.sum("d") / 2).alias("m"), F.sum("l").alias("l"), F.sum(F.col("d") ** 2).alias("dd"))
    return total.select(*keys, F.when(F.col("m") > 0, F.col("l") / F.col("m") - resolution * F.col("dd") / (4 * F.col("m") ** 2)).otherwise(0.0).alias("q"))


def contact_ratio(edges: DataFrame, labels: DataFrame, keys: Keys = K, mode: str = "max") -> DataFrame:
    """For labels a < b that touch: the share of residues of each that have a neighbour in the other, by ``mode``."""
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("size"))
    touching = _sided(edges, labels, keys).where("label_i <> label_j")
    both = touching.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("label_i").alias("own"), F.col("label_j").alias("other")), F.struct(F.col("j").alias("pos"), F.col("label_j").alias("own"), F.col("label_i").alias("other")))).alias("_s"))
    counts = both.select(*keys, "_s.*").distinct().groupBy(*keys, "own", "other").agg(F.count("*").alias("n"))
    share = counts.join(shuffled(sizes.withColumnRenamed("label", "own")), [*keys, "own"]).select(*keys, "own", "other", (F.col("n") / F.col("size")).alias("share"))
    back = share.select(*keys, F.col("other").alias("own"), F.col("own").alias("other"), F.col("share").alias("back"))
    pair = share.where("own < other").join(shuffled(back), [*keys, "own", "other"])
    ratio = {"max": F.greatest("share", "back"), "avg": (F.col("share") + F.col("back")) / 2, "min": F.least("share", "back")}[mode]
    return pair.select(*keys, F.col("own").alias("label_a"), F.col("other").alias("label_b"), ratio.alias("ratio"))


def boundary_nodes(edges: DataFrame, labels: DataFrame, keys: Keys = K) -> DataFrame:
    """For each label, the number of distinct residues on edges with exactly one end inside it."""
    crossing = _sided(edges, labels, keys).where("label_i <> label_j")
    touched = crossing.select(*keys, F.explode(F.array("label_i", "label_j")).alias("label"), "i", "j").select(*keys, "label", F.explode(F.array("i", "j")).alias("pos"))
    return touched.distinct().groupBy(*keys, "label").agg(F.count("*").alias("boundary_nodes"))


def _pairs(rows: DataFrame, own: Keys, block: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """All pairs i < j of one group, by blocks of places, so that a long chain is many tasks."""
    rows = rows.withColumn("_block", F.floor(F.col("pos") / block))
    rows = rows.join(rows.groupBy(*own).agg(F.max("_block").alias("_n")), list(own))
    left = rows.select(*own, F.col("_block").alias("_a"), F.explode(F.expr("sequence(_block, _n)")).alias("_b"), F.col("pos").alias("i"), *(F.col(c).alias(f"{c}_i") for c in carried), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    right = rows.select(*own, F.explode(F.expr("sequence(bigint(0), _block)")).alias("_a"), F.col("_block").alias("_b"), F.col("pos").alias("j"), *(F.col(c).alias(f"{c}_j") for c in carried), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    return left.join(right, [*own, "_a", "_b"]).where("i < j")


def reach(tolerance: float, d0: float = 8.0, sigma: float = 1.5) -> float:
    """The distance beyond which a contact weighs less than ``tolerance``."""
    return d0 + sigma * math.log(1 / tolerance - 1)


def _near_pairs(rows: DataFrame, own: Keys, cutoff: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """The pairs i < j of one group nearer than ``cutoff``, by cubes of that size and half of their neighbours: a
    residue meets those around it only, so the work grows with the chain's length and not with its square."""
    cells = rows.select(*own, "pos", *carried, *"xyz", *(F.floor(F.col(c) / cutoff).alias(f"_c{c}") for c in "xyz"))
    half = [(x, y, z) for x in (0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    around = F.array(*(F.struct(*((F.col(f"_c{c}") + d).alias(f"_c{c}") for c, d in zip("xyz", step, strict=True)), F.lit(step == (0, 0, 0)).alias("_own")) for step in half))
    names = lambda at, end: [F.col("pos").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in carried), *(F.col(c).alias(f"{end}{c}") for c in "xyz")]
    left = cells.select(*own, *(f"_c{c}" for c in "xyz"), *names("i", "a"))
    right = cells.select(*own, F.inline(around), *names("j", "b"))
    return left.join(right, [*own, "_cx", "_cy", "_cz"]).where("not _own or i < j").where(distance("a", "b") < cutoff)


def inter_domain_density(residues: DataFrame, labels: DataFrame, keys: Keys = K, alpha: float = 0.43, block: int = 256, tolerance: float | None = None) -> DataFrame:
    """For labels a < b: sum of contact weights over all pairs, times (n_a n_b)^-alpha. With ``tolerance`` pairs that
    weigh less are left out: the sum is short by at most ``tolerance`` for each pair, and pairs of labels that only such
    pairs join have no row."""
    rows = residues.join(labels.select(*keys, "pos", "label"), [*keys, "pos"])
    pairs = _pairs(rows, keys, block, ("label",)) if tolerance is None else _near_pairs(rows, keys, reach(tolerance), ("label",))
    pairs = pairs.where("label_i <> label_j")
    w = contact_weight(distance("a", "b"))
    total = pairs.groupBy(*keys, F.least("label_i", "label_j").alias("label_a"), F.greatest("label_i", "label_j").alias("label_b")).agg(F.sum(w).alias("total"))
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    for side in "ab":
        total = total.join(sizes.select(*keys, F.col("label").alias(f"label_{side}"), F.col("n").alias(f"n_{side}")), [*keys, f"label_{side}"])
    return total.select(*keys, "label_a", "label_b", (F.col("total") * F.pow((F.col("n_a") * F.col("n_b")).cast("double"), F.lit(-alpha))).alias("density"))


def intra_domain_density(residues: DataFrame, labels: DataFrame, keys: Keys = K, beta: float = 0.95, block: int = 256, tolerance: float | None = None) -> DataFrame:
    """For each label: sum of contact weights over pairs more than two places of the domain apart, times n^-beta. With
    ``tolerance`` pairs that weigh less are left out: the sum is short by at most ``tolerance`` for each pair."""
    place = F.row_number().over(along([*keys, "label"])).cast("int")
    placed = labels.select(*keys, "label", "pos", place.alias("place"))
    rows = residues.join(placed.select(*keys, "pos", "place"), [*keys, "pos"]).select(*keys, F.col("pos").alias("_pos"), F.col("place").alias("pos"), "x", "y", "z")
    own = [*keys, "label"]
    rows = rows.join(placed.select(*keys, F.col("pos").alias("_pos"), "label"), [*keys, "_pos"])
    pairs = _pairs(rows, own, block) if tolerance is None else _near_pairs(rows, own, reach(tolerance))
    total = pairs.where("abs(j - i) > 2").groupBy(*own).agg(F.sum(contact_weight(distance("a", "b"))).alias("total"))
    sizes = labels.groupBy(*own).agg(F.count("*").alias("n"))
    joined = sizes.join(total, own, "left")
    return joined.select(*own, (F.coalesce("total", F.lit(0.0)) * F.pow(F.col("n").cast("double"), F.lit(-beta))).alias("density"))
