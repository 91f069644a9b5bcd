"""Scores of predicted labels against true ones. Input ``both``: one row per residue with pos, true, pred (-1: linker).

The contingency is counted once by a partial aggregation; everything after it is small. Scores of segments and boundaries
start from the stretches that share both labels (``joint_runs``): one sort of the residues, from which the runs of either
side and the counts follow. A residue whose label is null on one side is no member of any domain or linker of that side;
chains whose key is null have no scores that need a join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import boundary_distance, range_gap
from ..schemas import K, Keys, along, before
from ..session import checkpoint_dir
from .intervals import domain_points, internal_linkers, label_runs


def _counts(both: DataFrame, keys: Keys) -> DataFrame:
    """n of the pairs of labels that a chain has."""
    return both.groupBy(*keys, "pred", "true").agg(F.count("*").alias("n"))


def contingency(both: DataFrame, keys: Keys = K) -> DataFrame:
    """n of every (pred, true) pair of labels of a chain, zeros included."""
    counts = _counts(both, keys)
    cells = counts.select(*keys, "pred").distinct().join(counts.select(*keys, "true").distinct(), list(keys))
    return cells.join(counts, [*keys, "pred", "true"], "left").select(*keys, "pred", "true", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def ndo(both: DataFrame, keys: Keys = K) -> DataFrame:
    """Normalised domain overlap; null if every residue is a true linker."""
    return _ndo(_counts(both, keys), keys)


def _ndo(counts: DataFrame, keys: Keys) -> DataFrame:
    core = (F.col("pred") != -1) & (F.col("true") != -1)
    labelled = counts.where(F.col("pred").isNotNull() & F.col("true").isNotNull())
    joined = counts.groupBy(*keys).agg(F.sum(F.when(F.col("true") != -1, F.col("n"))).alias("n"))
    for side in ("pred", "true"):
        per = labelled.where(F.col(side) != -1).groupBy(*keys, side).agg(F.max(F.when(core, F.col("n"))).alias("most"), F.sum("n").alias("n"))
        y = per.groupBy(*keys).agg(F.sum(2 * F.coalesce("most", F.lit(0)) - F.col("n")).alias(f"y_{side}"))
        joined = joined.join(y, list(keys), "left")
    y = F.coalesce("y_pred", F.lit(0)) + F.coalesce("y_true", F.lit(0))
    return joined.select(*keys, F.when(F.col("n") > 0, y / (2 * F.col("n"))).alias("ndo"))


def iou(both: DataFrame, keys: Keys = K) -> DataFrame:
    """True labels in order take the unused predicted label of largest overlap (the lowest on ties); the shared part of
    the union, weighted by true size. The greedy walk is a fold over one small array of each chain."""
    return _iou(_counts(both, keys), keys)


def _iou(counts: DataFrame, keys: Keys) -> DataFrame:
    counts = counts.withColumn("n", F.col("n").cast("int"))
    pred_size = Window.partitionBy(*keys, "pred")
    true_size = Window.partitionBy(*keys, "true")
    sized = counts.withColumn("p", F.sum("n").over(pred_size).cast("int")).withColumn("t", F.sum("n").over(true_size).cast("int")).where(F.col("true") != -1)
    per = sized.groupBy(*keys, "true", "t").agg(F.sort_array(F.collect_list(F.when(F.col("pred") != -1, F.struct((-F.col("n")).alias("minus"), "pred", "n", "p")))).alias("options"))
    rows = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("true", "t", "options"))).alias("domains"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("sum"), F.lit(0).alias("size"))

    def step(acc: Column, d: Column) -> Column:
        free = F.filter(d["options"], lambda o: ~F.array_contains(acc["used"], o["pred"]))
        best = F.get(free, F.lit(0))
        share = F.when(best.isNull(), 0.0).otherwise(best["n"] / (d["t"] + best["p"] - best["n"]))
        used = F.when(best.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], best["pred"]))
        return F.struct(used.alias("used"), (acc["sum"] + share * d["t"]).alias("sum"), (acc["size"] + d["t"]).alias("size"))

    folded = rows.select(*keys, F.aggregate("domains", start, step).alias("f"))
    chains = counts.select(*keys).distinct().join(folded, list(keys), "left")
    return chains.select(*keys, F.coalesce(F.when(F.col("f.size") > 0, F.col("f.sum") / F.col("f.size")), F.lit(0.0)).alias("iou"))


def cdo(both: DataFrame, keys: Keys = K, threshold: float = 0.85) -> DataFrame:
    """1 if every true domain overlaps some predicted one in more than ``threshold`` of its size."""
    counts = both.where(F.col("true") != -1).groupBy(*keys, "true", "pred").agg(F.count("*").alias("n"))
    per = counts.groupBy(*keys, "true").agg(F.sum("n").alias("size"), F.max(F.when(F.col("pred") != -1, F.col("n"))).alias("most"))
    good = per.groupBy(*keys).agg(F.min((F.coalesce("most", F.lit(0)) / F.col("size") > threshold).cast("int")).alias("cdo"))
    return both.select(*keys).distinct().join(good, list(keys), "left").select(*keys, F.coalesce("cdo", F.lit(0)).alias("cdo"))


def sdc(both: DataFrame, keys: Keys = K, include_outliers: bool = False) -> DataFrame:
    """How alike the numbers of domains are; null if neither side has one."""
    per = both.groupBy(*keys).agg(*(F.countDistinct(F.col(s) if include_outliers else F.when(F.col(s) != -1, F.col(s))).alias(s[0]) for s in ("true", "pred")))
    most = F.greatest("t", "p")
    return per.select(*keys, F.when(most > 0, (most - F.abs(F.col("t") - F.col("p"))) / most).alias("sdc"))


def norm_vi(both: DataFrame, keys: Keys = K) -> DataFrame:
    """Variation of information over ln N; -1 is a label. 0 for one residue."""
    counts = _counts(both, keys)
    total = F.sum("n").over(Window.partitionBy(*keys))
    rows = counts.withColumns({"total": total, "p": F.sum("n").over(Window.partitionBy(*keys, "pred")), "t": F.sum("n").over(Window.partitionBy(*keys, "true"))})
    # H(t) + H(p) - 2 MI = 2 H(t, p) - H(t) - H(p)
    share = F.col("n") / F.col("total")
    term = share * (F.log(F.col("p") / F.col("total")) + F.log(F.col("t") / F.col("total")) - 2 * F.log(share))
    per = rows.groupBy(*keys, "total").agg(F.sum(term).alias("vi"))
    return per.select(*keys, F.when(F.col("total") <= 1, 0.0).otherwise(F.col("vi") / F.log(F.col("total").cast("double"))).alias("norm_vi"))


def _side(both: DataFrame, keys: Keys, side: str) -> DataFrame:
    return both.select(*keys, "pos", F.col(side).alias("label"))


def joint_runs(both: DataFrame, keys: Keys = K) -> DataFrame:
    """Stretches of residues with the same two labels: run (from 0), true, pred, start, end, n. A residue without a place
    is a stretch without start."""
    w = along(keys)
    same = F.lag("pos").over(w).isNotNull()
    for side in ("true", "pred"):
        same = same & F.col(side).eqNullSafe(F.lag(side).over(w))
    rows = both.select(*keys, "pos", "true", "pred").withColumn("_new", (~same).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(before(keys)).cast("int") - 1)
    labels = (F.first(side).alias(side) for side in ("true", "pred"))
    return rows.groupBy(*keys, "run").agg(*labels, F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"))


def side_runs(joint: DataFrame, keys: Keys = K) -> DataFrame:
    """The runs of either side's labels, put together from ``joint_runs``: side, run (from 0), label, start, end, the ends
    moved over a linker that touches them (ext_start, ext_end), and what the run is at a chain's boundaries: whether it
    follows another domain directly (point), or is a linker inside (linker). Null labels that follow one another are one
    run; residues without a place are in none."""
    own = [*keys, "side"]
    labels = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("label")) for s in ("pred", "true")))).alias("l")
    rows = joint.where("start is not null").select(*keys, "start", "end", labels).select(*keys, "l.*", "start", "end")
    w = along(own, "start")
    new = F.lag("start").over(w).isNull() | ~F.col("label").eqNullSafe(F.lag("label").over(w))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(before(own, "start")).cast("int") - 1)
    runs = rows.groupBy(*own, "run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"))
    left = F.lag("label").over(along(own, "run"))
    last = F.max("run").over(Window.partitionBy(*own))
    linker = (F.col("label") == -1) & (F.col("run") > 0) & (F.col("run") < last)
    return _extended(runs, own).withColumns({"point": (left != -1) & (F.col("label") != -1), "linker": linker})


def segments(both: DataFrame, side: str, keys: Keys = K) -> DataFrame:
    """Segments of one side: start, end, and the ends moved over a linker that touches them (ext_start, ext_end)."""
    runs = _extended(label_runs(_side(both, keys, side), keys), keys).where("label <> -1")
    return runs.select(*keys, "run", "start", "end", "ext_start", "ext_end")


def _extended(runs: DataFrame, keys: Keys) -> DataFrame:
    w = along(keys, "run")
    prior = F.when((F.lag("label").over(w) == -1) & (F.lag("end").over(w) == F.col("start") - 1), F.lag("start").over(w))
    after = F.when((F.lead("label").over(w) == -1) & (F.lead("start").over(w) == F.col("end") + 1), F.lead("end").over(w))
    return runs.withColumns({"ext_start": F.coalesce(prior, "start"), "ext_end": F.coalesce(after, "end")})


def _distance() -> Column:
    """d of a predicted (p_) and a true (t_) segment. Moved starts are compared with moved ends only."""
    c = F.col
    tail = F.abs(c("p_ext_end") - c("t_ext_end"))
    moved = [(F.abs(c(a) - c(b)) + tail) / 2 for a in ("p_start", "p_ext_start") for b in ("t_start", "t_ext_start")]
    return F.least(boundary_distance(c("p_start"), c("p_end"), c("t_start"), c("t_end")), *moved)


def _both_sides(both: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Predicted and true segments, with the columns that ``_distance`` takes."""
    return _named(segments(both, "pred", keys), segments(both, "true", keys), keys)


def _named(pred: DataFrame, true: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    columns = ("run", "start", "end", "ext_start", "ext_end")
    return tuple(df.select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in columns)) for df, x in ((pred, "p"), (true, "t")))


def segment_distance(both: DataFrame, keys: Keys = K) -> DataFrame:
    """d of every (predicted, true) pair of segments of a chain."""
    p, t = _both_sides(both, keys)
    return p.join(t, list(keys)).select(*keys, F.col("p_run").alias("pred_run"), F.col("t_run").alias("true_run"), _distance().alias("d"))


def near_segments(p: DataFrame, t: DataFrame, keys: Keys, threshold: int) -> DataFrame:
    """The pairs of segments with d below ``threshold``; a pair may come more than once.

    d is half of a shift of starts (or moved starts) and one of ends, so the starts of such a pair lie less than twice
    the threshold apart: an equi-join on bands of that width and their neighbours finds them. A band holds as many
    segments as it has places at most, so pairs are linear in segments, however long the chain is.
    """
    width = 2 * threshold
    bands = lambda x: F.array(*(F.floor(F.col(f"{x}_{c}") / width) for c in ("start", "ext_start")))
    around = F.array_distinct(F.flatten(F.transform(bands("t"), lambda b: F.sequence(b - 1, b + 1))))
    p, t = p.withColumn("_band", F.explode(F.array_distinct(bands("p")))), t.withColumn("_band", F.explode(around))
    near = p.join(t, [*keys, "_band"]).withColumn("d", _distance()).where(F.col("d") < threshold)
    return near.select(*keys, F.col("p_run").alias("pred_run"), F.col("t_run").alias("true_run"), "d")


def csd(both: DataFrame, keys: Keys = K, threshold: int = 20) -> DataFrame:
    """Chain segment distance score; 0 without predicted segments, null without true ones."""
    joint = joint_runs(both, keys)
    return _csd(joint, side_runs(joint, keys), keys, threshold)


def _csd(joint: DataFrame, runs: DataFrame, keys: Keys, threshold: int = 20) -> DataFrame:
    segs = runs.where("label <> -1")
    p, t = _named(segs.where("side = 'pred'"), segs.where("side = 'true'"), keys)
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_run").alias("run")) for s in ("pred", "true")))).alias("e")
    near = near_segments(p, t, keys, threshold).select(*keys, ends, (F.lit(threshold) - F.col("d")).alias("s"))
    # Every segment has 0 at least; other runs, and chains without places, stand for their chain only.
    every = runs.select(*keys, F.when(F.col("label") != -1, F.col("side")).alias("side"), "run", F.lit(0.0).alias("s"))
    bare = joint.where("start is null").select(*keys, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0.0))
    best = near.select(*keys, "e.*", "s").union(every).union(bare).groupBy(*keys, "side", "run").agg(F.max("s").alias("s"))
    own = {s: F.when(F.col("side") == s, F.col("s")) for s in ("pred", "true")}
    per = best.groupBy(*keys).agg(*(f(c).alias(f"{x}_{s}") for s, c in own.items() for x, f in (("n", F.count), ("s", F.sum))))
    n_pred, n_true = F.col("n_pred"), F.col("n_true")
    score = F.when(n_pred >= n_true, F.col("s_pred") / (threshold * n_pred)).otherwise(F.col("s_true") / (threshold * n_true))
    keyless = reduce(or_, (F.col(k).isNull() for k in keys))
    return per.select(*keys, F.when((n_true == 0) | keyless, None).when(n_pred == 0, 0.0).otherwise(score).alias("csd"))


def boundary_entities(both: DataFrame, side: str, keys: Keys = K) -> DataFrame:
    """Domain-domain points and inner linkers of one side as ranges."""
    labels = _side(both, keys, side)
    return domain_points(labels, keys).unionByName(internal_linkers(labels, keys))


def _entities(both: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Predicted and true entities."""
    return tuple(boundary_entities(both, s, keys).select(*keys, F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end")) for s in ("pred", "true"))


def boundary_gap(both: DataFrame, keys: Keys = K) -> DataFrame:
    """d of every (predicted, true) pair of boundary entities of a chain."""
    p, t = _entities(both, keys)
    return p.join(t, list(keys)).withColumn("d", range_gap(F.col("pred_start"), F.col("pred_end"), F.col("true_start"), F.col("true_end")))


def near_boundaries(p: DataFrame, t: DataFrame, keys: Keys, threshold: int) -> DataFrame:
    """d of the pairs of entities of both sides that lie less than ``threshold`` apart, by an equi-join on bands of that
    width: predicted ranges go to their own bands, true ones, wider by the threshold on both ends, to theirs, and a pair
    counts in the first band that both have."""
    band = lambda c: F.floor(c / threshold)
    p = p.withColumn("_first_p", band(F.col("pred_start"))).withColumn("_band", F.explode(F.sequence("_first_p", band(F.col("pred_end")))))
    t = t.withColumn("_first_t", band(F.col("true_start") - threshold)).withColumn("_band", F.explode(F.sequence("_first_t", band(F.col("true_end") + threshold))))
    met = p.join(t, [*keys, "_band"]).where(F.col("_band") == F.greatest("_first_p", "_first_t"))
    gap = range_gap(F.col("pred_start"), F.col("pred_end"), F.col("true_start"), F.col("true_end"))
    return met.withColumn("d", gap).where(F.col("d") < threshold).select(*keys, "d")


def dbd(both: DataFrame, keys: Keys = K, threshold: int = 20) -> DataFrame:
    """Domain boundary distance score: a sum over the pairs nearer than ``threshold``. Single-domain cases are decided
    first; null without entities on a side."""
    joint = joint_runs(both, keys)
    return _dbd(joint, side_runs(joint, keys), keys, threshold)


def _dbd(joint: DataFrame, runs: DataFrame, keys: Keys, threshold: int = 20) -> DataFrame:
    domains = joint.groupBy(*keys).agg(*(F.countDistinct(F.when(F.col(s) != -1, F.col(s))).alias(s[0]) for s in ("true", "pred")))
    ranges = runs.where("point or linker").select(*keys, "side", "start", F.when(F.col("point"), F.col("start")).otherwise(F.col("end")).alias("end"))
    p, t = (ranges.where(F.col("side") == s).select(*keys, F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end")) for s in ("pred", "true"))
    total = near_boundaries(p, t, keys, threshold).groupBy(*keys).agg(F.sum(F.lit(threshold) - F.col("d")).alias("s"))
    sizes = ranges.groupBy(*keys).agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("pred", "true")))
    joined = domains.join(total, list(keys), "left").join(sizes, list(keys), "left")
    t, p = F.col("t"), F.col("p")
    none = (F.coalesce("n_pred", F.lit(0)) == 0) | (F.coalesce("n_true", F.lit(0)) == 0)
    score = F.when(~none, F.coalesce("s", F.lit(0)) / (threshold * F.greatest("n_pred", "n_true")))
    return joined.select(*keys, F.when((t == 1) & (p == 1), 1.0).when((t == 1) | (p == 1), 0.0).when((t == 0) != (p == 0), 1.0).otherwise(score).alias("dbd"))


def score_report(both: DataFrame, keys: Keys = K, digits: int = 3) -> DataFrame:
    """CSD, IoU, NDO and DBD of every chain, rounded. The labels are read and sorted once, into stretches that share both
    labels; only these, and the runs put together from them, are checkpointed, and all four scores follow from them."""
    checkpoint_dir(both.sparkSession)
    joint = joint_runs(both, keys).checkpoint()
    runs = side_runs(joint, keys).checkpoint()
    counts = joint.groupBy(*keys, "pred", "true").agg(F.sum("n").alias("n"))
    out = _csd(joint, runs, keys)
    for scored in (_iou(counts, keys), _ndo(counts, keys), _dbd(joint, runs, keys)):
        out = out.join(scored, list(keys))
    return out.select(*keys, *(F.round(c, digits).alias(c) for c in ("csd", "iou", "ndo", "dbd")))
