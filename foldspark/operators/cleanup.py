"""Cleaning labels: secondary structure, outliers, short runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..schemas import K, Keys, along, before, shuffled
from .chains import each_chain
from .graph import _pairs, node_degree
from .intervals import _runs, label_runs, ranges_of


def terminal_low_degree(edges: DataFrame, labels: DataFrame, keys: Keys = K, threshold: int = 2, min_run: int = 10) -> DataFrame:
    """Residues of low degree at the ends of the ranges of each cluster, in unbroken runs of at least ``min_run``."""
    own = [*keys, "label"]
    ranges = ranges_of(labels.where("label <> -1").select(*own, F.col("pos").alias("value")), own)
    members = ranges.select(*own, "range_no", F.explode(F.sequence("start", "end")).alias("pos"))
    degrees = members.join(shuffled(node_degree(edges, keys).select(*keys, "pos", "degree")), [*keys, "pos"], "left").withColumn("_low", F.coalesce("degree", F.lit(0)) <= threshold)
    span = [*own, "range_no"]
    ahead = Window.partitionBy(*span).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = (~F.col("_low")).cast("int")
    marked = degrees.withColumn("_f", F.max(high).over(before(span))).withColumn("_b", F.max(high).over(ahead)).where("_f = 0 or _b = 0")
    runs = ranges_of(marked.select(*own, F.col("pos").alias("value")), own).where(F.col("end") - F.col("start") + 1 >= min_run)
    return runs.select(*own, F.explode(F.sequence("start", "end")).alias("pos"))


def curate_by_ss(labels: DataFrame, keys: Keys = K, min_ss_length: int = 3) -> DataFrame:
    """Helices and strands of at least ``min_ss_length`` take the label that most of their residues have (not -1), the
    one seen first on ties. Input has ss and label."""
    runs = label_runs(labels.select(*keys, "pos", "ss"), keys, "ss").where(F.col("ss").isin("H", "E") & (F.col("length") >= min_ss_length))
    members = runs.select(*keys, "run", F.explode(F.sequence("start", "end")).alias("pos")).join(labels.select(*keys, "pos", "label"), [*keys, "pos"])
    votes = members.where("label <> -1").groupBy(*keys, "run", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    winner = votes.groupBy(*keys, "run").agg(F.max(F.struct("n", (-F.col("first")).alias("_f"), "label")).alias("_w"))
    new = members.select(*keys, "run", "pos").join(winner, [*keys, "run"]).select(*keys, "pos", F.col("_w.label").alias("_new"))
    return labels.join(new, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("_new", "label").alias("label"))


def merge_outlier_segments(labels: DataFrame, keys: Keys = K, min_length: int = 10, max_length: int = 100) -> DataFrame:
    """Outlier runs shorter than ``min_length`` or as long as ``max_length`` take the label of the longer neighbour (the
    left on ties); a chain of one run stays."""
    w = along(keys, "run")
    runs = label_runs(labels, keys)
    left, right = (f(F.struct("label", "length")).over(w) for f in (F.lag, F.lead))
    runs = runs.withColumn("_l", left).withColumn("_r", right)
    side = F.when(F.col("_l").isNull(), F.col("_r.label")).when(F.col("_r").isNull(), F.col("_l.label")).when(F.col("_l.length") >= F.col("_r.length"), F.col("_l.label")).otherwise(F.col("_r.label"))
    odd = (F.col("label") == -1) & ((F.col("length") < min_length) | (F.col("length") >= max_length))
    runs = runs.withColumn("label", F.when(odd, F.coalesce(side, "label")).otherwise(F.col("label")))
    return runs.select(*keys, F.explode(F.sequence("start", "end")).alias("pos"), "label")


def _sized(residues: DataFrame, labels: DataFrame, keys: Keys, least: int) -> tuple[DataFrame, DataFrame]:
    """Sizes of the clusters that count (``least`` residues or more, in chains with two of them), and their residues."""
    sizes = labels.where("label <> -1").groupBy(*keys, "label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    sizes = sizes.withColumn("_k", F.count("*").over(Window.partitionBy(*keys))).where("_k >= 2").drop("_k")
    rows = residues.select(*keys, "pos", "x", "y", "z").join(labels.select(*keys, "pos", "label"), [*keys, "pos"])
    return sizes, rows.join(sizes, [*keys, "label"])


def _silhouettes(sums: DataFrame, own: DataFrame, sizes: DataFrame, keys: Keys) -> DataFrame:
    """pos, silhouette from the distances of residues summed per cluster (pos, other, total)."""
    other = sums.join(sizes.withColumnsRenamed({"label": "other", "size": "n"}), [*keys, "other"]).join(own.select(*keys, "pos", "label", "size"), [*keys, "pos"])
    same = F.col("other") == F.col("label")
    per = other.groupBy(*keys, "pos", "size").agg(F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("size") == 1, 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return per.select(*keys, "pos", value.alias("silhouette"))


def silhouette_points(residues: DataFrame, labels: DataFrame, keys: Keys = K, min_cluster_size: int = 5, block: int = 256) -> DataFrame:
    """Silhouette of the residues of clusters of at least ``min_cluster_size``; null elsewhere, and in chains of fewer
    than two such clusters. Distances are summed per (residue, cluster) before they are shuffled."""
    sizes, rows = _sized(residues, labels, keys, min_cluster_size)
    pairs = _pairs(rows, keys, block, ("label",)).withColumn("d", distance("a", "b"))
    sides = F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("label_j").alias("other")), F.struct(F.col("j").alias("pos"), F.col("label_i").alias("other")))).alias("_s")
    sums = pairs.select(*keys, sides, "d").groupBy(*keys, "_s.pos", "_s.other").agg(F.sum("d").alias("total"))
    per = _silhouettes(sums, rows, sizes, keys)
    return labels.select(*keys, "pos", "label").join(per, [*keys, "pos"], "left").select(*keys, "pos", "label", "silhouette")


def silhouette_bounds(rows: DataFrame, asked: DataFrame, keys: Keys) -> DataFrame:
    """pos, least, most: what the silhouette of each of ``asked`` lies between, from the clusters' shapes alone.

    With centroid c and mean square spread V of a cluster, the mean distance from a point at distance d of c is at least d
    (the norm of a mean) and at most sqrt(d^2 + V) (the root of the mean square); a residue's own cluster of n counts
    n / (n - 1) of that. The silhouette grows with the distance of the nearest other cluster and falls with that of
    its own. Residues of clusters of one are left out."""
    shape = rows.groupBy(*keys, F.col("label").alias("other")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"b{c}") for c in "xyz"), sum((F.var_pop(c) for c in "xyz"), F.lit(0.0)).alias("v"))
    met = asked.select(*keys, "pos", "label", *(F.col(c).alias(f"a{c}") for c in "xyz")).join(shape, list(keys)).withColumn("d", distance("a", "b"))
    own = F.col("other") == F.col("label")
    scale = F.when(own, F.col("n") / (F.col("n") - 1)).otherwise(1.0)
    met = met.where(~own | (F.col("n") > 1)).withColumn("low", F.col("d") * scale).withColumn("high", F.sqrt(F.col("d") ** 2 + F.col("v")) * scale)
    per = met.groupBy(*keys, "pos").agg(*(f(F.when(side, F.col(c))).alias(name) for f, side, c, name in ((F.max, own, "low", "a1"), (F.max, own, "high", "a2"), (F.min, ~own, "low", "b1"), (F.min, ~own, "high", "b2"))))
    value = lambda b, a: F.when(F.greatest(a, b) > 0, (F.col(b) - F.col(a)) / F.greatest(a, b)).otherwise(0.0)
    return per.where("a1 is not null and b1 is not null").select(*keys, "pos", value("b1", "a2").alias("least"), value("b2", "a1").alias("most"))


def badly_placed(residues: DataFrame, labels: DataFrame, asked: DataFrame, keys: Keys, tau: float, min_cluster_size: int, block: int = 256) -> DataFrame:
    """The residues among ``asked`` (keys, pos) whose silhouette is below ``tau``. Bounds decide most; distances are
    summed for the others only, by blocks of places, so a long chain is many tasks."""
    sizes, rows = _sized(residues, labels, keys, min_cluster_size)
    some = rows.join(asked.select(*keys, "pos"), [*keys, "pos"], "left_semi")
    tried = some.join(silhouette_bounds(rows, some, keys), [*keys, "pos"], "left")
    sure, slack = F.col("most") < tau - 1e-9, F.coalesce((F.col("most") < tau - 1e-9) | (F.col("least") >= tau + 1e-9), F.lit(False))
    open_ = tried.where(~slack)
    ends = rows.groupBy(*keys).agg(F.max(F.floor(F.col("pos") / block)).alias("_n"))
    left = open_.select(*keys, "pos", *(F.col(c).alias(f"a{c}") for c in "xyz")).join(ends, list(keys)).withColumn("_block", F.explode(F.expr("sequence(bigint(0), _n)")))
    right = rows.select(*keys, F.floor(F.col("pos") / block).alias("_block"), F.col("label").alias("other"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    sums = left.join(right, [*keys, "_block"]).groupBy(*keys, "pos", "other").agg(F.sum(distance("a", "b")).alias("total"))
    exact = _silhouettes(sums, open_, sizes, keys).where(F.col("silhouette") < tau)
    return tried.where(sure).select(*keys, "pos").unionByName(exact.select(*keys, "pos"))


def choose_k(residues: DataFrame, candidates: DataFrame, keys: Keys = K, kmin: int = 2, kmax: int = 10) -> DataFrame:
    """Number of clusters whose labeling (k, pos, label in ``candidates``) has the best mean silhouette: k, score,
    fallback. The smallest k on ties; (1, -1, true) where none has two labels."""
    own = [*keys, "k"]
    n = residues.groupBy(*keys).agg(F.count("*").alias("_n"))
    tried = candidates.join(n, list(keys)).where((F.col("k") >= max(2, kmin)) & (F.col("k") <= F.least(F.lit(kmax), F.greatest(F.lit(2), F.col("_n") - 1)))).select(*own, "pos", "label")
    spread = residues.select(*keys, "pos", "x", "y", "z").join(tried.select(*own, "pos"), [*keys, "pos"])
    points = silhouette_points(spread, tried, own, 1)
    mean = points.where("silhouette is not null").groupBy(*own).agg(F.round(F.avg("silhouette"), 9).alias("score")).where("score > -1")
    best = mean.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("k")).alias("_k"))).alias("_b"))
    every = residues.select(*keys).distinct().join(best, list(keys), "left")
    return every.select(*keys, F.coalesce(-F.col("_b._k"), F.lit(1)).cast("int").alias("k"), F.coalesce("_b.score", F.lit(-1.0)).alias("score"), F.col("_b").isNull().alias("fallback"))


def mark_outliers(residues: DataFrame, labels: DataFrame, keys: Keys = K, tau: float = 0.1, max_expand: int = 30, cleanup_min_run: int = 3, min_cluster_size: int = 5, coil: tuple[str, ...] = ("C", "T", "S")) -> DataFrame:
    """Mark badly placed coil residues at the ends of runs as -1, at most ``max_expand`` in a row from each end, then
    fill marked runs shorter than ``cleanup_min_run`` between equal labels. ``labels`` has ss and label.

    Ends are the chain's ends and both sides of every direct change from one domain to another. Only residues that an
    unbroken stretch of coil joins to an end are looked at: no other can be marked.
    """
    w = along(keys)
    rows = labels.select(*keys, "pos", "ss", "label")
    beside = rows.withColumn("_left", F.lag("label").over(w)).withColumn("_right", F.lead("label").over(w))
    beside = _runs(beside, keys, F.col("label") != F.lag("label").over(w))
    span = [*keys, "run"]
    whole, ahead = Window.partitionBy(*span), Window.partitionBy(*span).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, last = F.min("pos").over(whole), F.max("pos").over(whole)
    from_left = F.coalesce(F.first("_left").over(before(span)) != -1, F.lit(True))
    from_right = F.coalesce(F.first("_right").over(ahead) != -1, F.lit(True))
    near_left, near_right = from_left & (F.col("pos") - first < max_expand), from_right & (last - F.col("pos") < max_expand)
    placed = beside.withColumn("_fl", near_left).withColumn("_fr", near_right)

    def reached(good: Column) -> tuple[Column, Column]:
        """Whether no good residue stands between a residue and the left, or the right, end of its run."""
        good = F.coalesce(good, F.lit(True)).cast("int")
        return F.col("_fl") & (F.max(good).over(before(span)) == 0), F.col("_fr") & (F.max(good).over(ahead) == 0)

    left, right = reached((F.col("label") == -1) | ~F.col("ss").isin(*coil))
    asked = placed.withColumn("_asked", left | right).where("_asked").select(*keys, "pos")
    bad = badly_placed(residues, labels, asked, keys, tau, min_cluster_size).withColumn("_bad", F.lit(True))
    rows = placed.join(bad, [*keys, "pos"], "left")
    left, right = reached(F.col("_bad").isNull())
    marked = rows.select(*keys, "pos", F.when(left | right, -1).otherwise(F.col("label")).alias("label"))
    w = along(keys, "run")
    short = label_runs(marked, keys)
    fill = (F.col("label") == -1) & (F.col("length") < cleanup_min_run) & (F.lag("label").over(w) == F.lead("label").over(w))
    short = short.withColumn("label", F.when(F.coalesce(fill, F.lit(False)), F.lag("label").over(w)).otherwise(F.col("label")))
    return short.select(*keys, F.explode(F.sequence("start", "end")).alias("pos"), "label")


def merged_run_table(label: np.ndarray, size: np.ndarray, min_size: int = 30, passes: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Labels and sizes of a chain's runs after short runs went to a neighbour, pass by pass; sizes are those at the start
    of a pass, and neighbours that come to have one label are one run in the next."""
    value, size = np.asarray(label), np.asarray(size)
    if size.sum() < min_size:
        return np.full(min(1, len(size)), -1), size.sum(keepdims=True)[: len(size)]
    for _ in range(passes):
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        value, size = value[starts], np.add.reduceat(size, starts)
        short = (value != -1) & (size < min_size)
        if not short.any():
            break
        none = np.int64(-1)
        left, right = np.r_[none, value[:-1]], np.r_[value[1:], none]
        left_size, right_size = np.r_[0, size[:-1]], np.r_[size[1:], 0]
        lone = np.arange(len(value)) == len(value) - 1
        takes_left = (left != -1) & (lone | (left_size >= right_size))
        value = np.where(short, np.where(takes_left, left, right), value)
    return value, size


def merged_runs(labels: list[int], min_size: int = 30, passes: int = 300) -> list[int]:
    """``merged_run_table`` of residues."""
    label, size = merged_run_table(np.asarray(labels), np.ones(len(labels), np.int64), min_size, passes)
    return np.repeat(label, size).tolist()


def _halves(own: np.ndarray, a: int, b: int) -> list[tuple[np.ndarray, int]]:
    """Places given to two labels: the smaller half to the left one; a single place to the left."""
    half = len(own) // 2 if len(own) > 1 else 1
    return [(own[:half], a), (own[half:], b)]


def relabelled(runs: list[tuple[int, np.ndarray]], i: int, short: int, low: int, high: int) -> list[tuple[np.ndarray, int]]:
    """Changes (places, label) that run ``i`` of (label, places) asks for."""
    label, own = runs[i]
    if len(runs) == 1:
        return []
    n, last = len(own), len(runs) - 1
    before_, after = runs[i - 1] if i else None, runs[i + 1] if i < last else None
    whole = lambda value: [(own, value)]
    if label == -1:
        # One residue takes the label before it; at the chain's start that of its end.
        out = whole(runs[i - 1][0]) if n == 1 else []
        if i in (0, last):
            side = after if i == 0 else before_
            return out + (whole(side[0]) if side[0] != -1 and not low <= n < high and len(side[1]) >= short else [])
        a, b = before_[0], after[0]
        if -1 not in (a, b):
            out += whole(a) if a == b else _halves(own, a, b) if n < low else []
        return out
    if n >= short:
        return []
    if i in (0, last):
        side, step = (after, 1) if i == 0 else (before_, -1)
        if len(side[1]) > n:
            return whole(side[0])
        far = i + 2 * step
        if side[0] == -1 and 0 <= far <= last:
            return _halves(side[1], *(label, runs[far][0])[::step]) if len(side[1]) > 1 else [(side[1], runs[max(i, far)][0])]
        return []
    (a, left), (b, right) = (before_[0], len(before_[1])), (after[0], len(after[1]))
    if a == b and (left >= short and right >= short if a == -1 else left + right > n):
        return whole(a)
    if a != b and -1 not in (a, b) and left > short and right > short:
        return _halves(own, a, b)
    if a != b and a == -1 and right > short:
        return whole(b)
    if a != b and b == -1 and left > short:
        return whole(a)
    if left > n:
        return whole(a if left > right else b)
    return whole(b) if right > n else []


def post_processed(
    labels: list[int] | np.ndarray, short: int = 30, low: int = 10, high: int = 100, passes: int = 31, places: np.ndarray | None = None
) -> list[int]:
    """Repeat all rules on the runs of a pass until nothing is asked for; later runs override earlier ones.

    ``places`` are the residues' positions. A residue of a domain that does not follow the one before it belongs to no
    run, though the run goes on: it is not counted and keeps its label. A chain of one residue stays.
    """
    y = np.asarray(labels, dtype=np.int64).copy()
    follows = np.diff(np.arange(len(y)) if places is None else np.asarray(places)) == 1
    for _ in range(passes if len(y) > 1 else 0):
        new = np.r_[True, y[1:] != y[:-1]]
        counted = new | (y == -1) | np.r_[True, follows]
        starts = np.flatnonzero(new)
        members = [np.flatnonzero(counted[a:b]) + a for a, b in zip(starts, np.r_[starts[1:], len(y)], strict=True)]
        runs = [(int(y[own[0]]), own) for own in members]
        changes = [c for i in range(len(runs)) for c in relabelled(runs, i, short, low, high) if len(c[0])]
        for own, value in changes:
            y[own] = value
        if not changes:
            break
    return y.tolist()


def _each_chain(labels: DataFrame, keys: Keys, f) -> DataFrame:
    """Labels anew from ``f`` (labels, first and last places of a chain's stretches) -> (labels, sizes of runs).

    A stretch has one label and no gap in its places. Only stretches leave the tasks that hold the residues; chains are
    dealt to tasks by size, and their runs come back and are laid out as places again."""
    keys = list(keys)
    rows = labels.select(*keys, "pos", F.coalesce("label", F.lit(-1)).alias("label")).where("pos is not null")
    w = along(keys)
    rows = _runs(rows, keys, (F.col("label") != F.lag("label").over(w)) | (F.col("pos") != F.lag("pos").over(w) + 1))
    stretches = rows.groupBy(*keys, "run").agg(F.first("label").alias("label"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    costs = rows.groupBy(*keys).agg(F.count("*").alias("cost"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        first, last = (rows[c].to_numpy(np.int64) for c in ("start", "end"))
        label, size = f(rows["label"].to_numpy(np.int64), first, last)
        # Places of the new runs, cut at the gaps.
        places, ends = last - first + 1, np.cumsum(size)
        cuts = np.unique(np.concatenate([np.cumsum(places), ends]))
        begins = np.r_[0, cuts[:-1]]
        of = np.searchsorted(np.cumsum(places), begins, "right")
        start = first[of] + begins - (np.cumsum(places) - places)[of]
        out = {"start": start, "end": start + cuts - begins - 1, "label": label[np.searchsorted(ends, begins, "right")]}
        return pd.DataFrame({**{k: [v] * len(start) for k, v in zip(keys, key, strict=True)}, **out})

    types = dict(labels.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"start {types['pos']}, end {types['pos']}, label {types['label']}"])
    done = each_chain(stretches.drop("run"), costs, keys, run, schema)
    return done.select(*keys, F.explode(F.sequence("start", "end")).alias("pos"), "label")


def merge_small_clusters(labels: DataFrame, keys: Keys = K, min_size: int = 30) -> DataFrame:
    """Short runs join a neighbour, to a fixed point of at most 300 passes; chains below ``min_size`` become -1. Null
    labels count as -1, rows without place are left out."""
    return _each_chain(labels, keys, lambda y, first, last: merged_run_table(y, last - first + 1, min_size))


def post_process(labels: DataFrame, keys: Keys = K, short: int = 30, low: int = 10, high: int = 100) -> DataFrame:
    """Clean short domain runs and outlier runs by the rules of ``relabelled``, in at most 31 passes. Gaps in ``pos`` count
    as in ``post_processed``. Null labels count as -1, rows without place are left out."""

    def cleaned(y: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = last - first + 1
        places = np.repeat(first - (size.cumsum() - size), size) + np.arange(size.sum())
        out = np.array(post_processed(np.repeat(y, size), short, low, high, places=places))
        starts = np.flatnonzero(np.r_[True, out[1:] != out[:-1]])
        return out[starts], np.diff(np.r_[starts, len(out)])

    return _each_chain(labels, keys, cleaned)
