"""Splitting of long chains: rounds over (chain, fragment) rows instead of a recursion in one task.

A fragment has a path: the empty text for the whole chain, then ``0`` for every left and ``1`` for every right part, so
paths sort into the order in which a recursion meets the pieces. A round finds the best cut of every long open fragment
with the operators of ``operators.cuts``, whose work is spread over tasks inside a fragment too, and moves places and
edges to the parts by arithmetic: edges between parts go, places are numbered anew. Fragments of at most ``longest``
residues are finished by the recursion of ``functions.splitting``, a fragment a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import splitting as S
from ..operators.chains import each_chain, effort
from ..operators.cuts import OTHER_MIN, PROTEIN_MIN, best_continuous_cut, best_discontinuous_cut
from ..schemas import Keys
from ..session import checkpoint_dir

#: Residues of the longest fragment that one task splits.
LONGEST = 20_000


def least_length(chain_type: Column) -> Column:
    return F.when(chain_type == "protein", PROTEIN_MIN).otherwise(OTHER_MIN)


def _allowed(nodes: DataFrame, opened: DataFrame, cuts: DataFrame, limited: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """Places k of fragments, counted inside them: those of ``cuts`` that lie in the fragment, as offsets from its first
    residue, and all places of chains without cuts."""
    span = nodes.join(opened.select(*own), own, "left_semi").groupBy(*own).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    some = span.join(cuts.select(*keys, "k").distinct(), keys).where("k > _first and k <= _last")
    some = some.select(*own, (F.col("k") - F.col("_first")).alias("k"))
    free = opened.where("n > 1").join(limited, keys, "left_anti")
    return some.unionByName(free.select(*own, F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")))


def _decided(opened: DataFrame, edges: DataFrame, own: list[str], split: float, min_gap: int, resolution: float, allowed: DataFrame | None) -> DataFrame:
    """Open fragments with their best split: continuous at ``k`` (last place of the left part), or the middle (t, v].
    ``apart`` is whether it reaches ``split``."""
    least = F.col("least")
    one = best_continuous_cut(edges, opened, own, least, resolution, allowed)
    two = best_discontinuous_cut(edges, opened, own, least, min_gap, resolution).withColumnRenamed("q", "q2")
    both = opened.join(one, own, "left").join(two, own, "left")
    first = F.col("q").isNotNull() & (F.col("q2").isNull() | (F.col("q") >= F.col("q2")))
    best = F.when(first, F.col("q")).otherwise(F.col("q2"))
    for c in ("t", "v"):
        both = both.withColumn(c, F.when(~first, F.col(c)))
    return both.select(*own, "n", F.when(first, F.col("k")).alias("k"), "t", "v", F.coalesce(best >= split, F.lit(False)).alias("apart"))


def _moved(at: Column) -> tuple[Column, Column]:
    """Whether a place lies in the right part, and its place there or in the left part."""
    k, t, v = F.col("k"), F.col("t"), F.col("v")
    right = F.when(k.isNotNull(), at > k).otherwise((at > t) & (at <= v))
    inside = F.when(k.isNotNull(), at - k - 1).otherwise(at - t - 1)
    left = F.when(k.isNull() & (at > v), at - (v - t)).otherwise(at)
    return right, F.when(right, inside).otherwise(left).cast("int")


def split_long(edges: DataFrame, sizes: DataFrame, keys: Keys, cuts: DataFrame | None, split: float, min_gap: int, resolution: float, longest: int = LONGEST) -> DataFrame:
    """pos, label of every residue of the chains in ``sizes`` (n, chain_type), as ``top_down`` labels them. ``edges``
    have the weights that count; chains with rows in ``cuts`` (k) are cut there only, at none for k = -1 alone."""
    spark, keys = edges.sparkSession, list(keys)
    checkpoint_dir(spark)
    chain = [*keys, "least"]
    own = [*chain, "path"]
    start = sizes.select(*keys, least_length(F.col("chain_type")).alias("least"), F.lit("").alias("path"), F.col("n").cast("int").alias("n"), F.lit(False).alias("done"))
    fragments = start.checkpoint()
    nodes = fragments.select(*own, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).withColumn("at", F.col("pos"))
    whole = edges.join(fragments.select(*chain), keys).withColumn("path", F.lit(""))
    held = whole.select(*own, "i", "j", F.col("i").alias("first"), F.col("j").alias("second"), "weight")
    limited = cuts.select(*keys).distinct() if cuts is not None else None
    opened = F.col("n") > longest
    while True:
        waiting = fragments.where(opened & ~F.col("done")).select(*own, "n")
        if waiting.isEmpty():
            break
        allowed = _allowed(nodes, waiting, cuts, limited, keys, own) if cuts is not None else None
        inside = held.join(waiting.select(*own), own, "left_semi").select(*own, "i", "j", "weight")
        found = _decided(waiting, inside, own, split, min_gap, resolution, allowed).checkpoint()
        # A fragment that is not split stays whole for good; of others the parts go on.
        parts = found.where("apart").withColumn("_right", F.coalesce(F.col("n") - F.col("k") - 1, F.col("v") - F.col("t")))
        size = F.explode(F.array(F.struct(F.lit("0").alias("s"), (F.col("n") - F.col("_right")).alias("m")), F.struct(F.lit("1").alias("s"), F.col("_right").alias("m"))))
        parts = parts.withColumn("_p", size).select(*chain, F.concat("path", F.col("_p.s")).alias("path"), F.col("_p.m").cast("int").alias("n"), F.lit(False).alias("done"))
        kept = fragments.join(found.select(*own, "apart"), own, "left").where(~F.coalesce("apart", F.lit(False)))
        kept = kept.select(*chain, "path", "n", (F.col("done") | F.col("apart").isNotNull()).alias("done"))
        fragments = kept.unionByName(parts).checkpoint()
        by = found.where("apart").drop("n", "apart")
        right, at = _moved(F.col("at"))
        there = F.coalesce("k", "t").isNotNull()
        path = F.when(there, F.concat("path", F.when(right, "1").otherwise("0"))).otherwise(F.col("path"))
        nodes = nodes.join(by, own, "left").select(*chain, path.alias("path"), "pos", F.when(there, at).otherwise(F.col("at")).alias("at")).checkpoint()
        (left_end, i), (right_end, j) = _moved(F.col("i")), _moved(F.col("j"))
        moved = held.join(by, own, "left").where(~there | (left_end == right_end))
        path = F.when(there, F.concat("path", F.when(left_end, "1").otherwise("0"))).otherwise(F.col("path"))
        # Places of one part keep their order, so i < j holds again.
        ends = [F.when(there, x).otherwise(F.col(c)).alias(c) for x, c in ((i, "i"), (j, "j"))]
        held = moved.select(*chain, path.alias("path"), *ends, "first", "second", "weight").checkpoint()
    return _finished(fragments, nodes, held, cuts, limited, keys, own, split, min_gap, resolution)


def _finished(fragments: DataFrame, nodes: DataFrame, held: DataFrame, cuts: DataFrame | None, limited: DataFrame | None, keys: list[str], own: list[str], split: float, min_gap: int, resolution: float) -> DataFrame:
    """Labels of all residues: the recursion splits what is left to split, and pieces are numbered along the paths."""
    types = dict(fragments.dtypes)
    left = fragments.where("not done").select(*own)
    none = F.lit(0).cast("int")
    rows = nodes.join(left, own, "left_semi").select(*own, F.lit(0).alias("kind"), F.col("pos").alias("a"), none.alias("b"), F.lit(0.0).alias("weight"))
    rows = rows.unionByName(held.join(left, own, "left_semi").select(*own, F.lit(1).alias("kind"), F.col("first").alias("a"), F.col("second").alias("b"), "weight"))
    if cuts is not None:
        rows = rows.unionByName(left.join(cuts, keys).select(*own, F.lit(2).alias("kind"), F.col("k").alias("a"), none.alias("b"), F.lit(0.0).alias("weight")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, edges, sites = (rows[rows["kind"] == k] for k in range(3))
        edges = edges.sort_values(["a", "b"])
        pos = np.sort(nodes["a"].to_numpy(np.int64))
        graph = S.Edges(int(pos[-1]) + 1 if len(pos) else 0, edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64), edges["weight"].to_numpy(float))
        allowed = sites["a"].to_numpy(np.int64) if len(sites) else None
        pieces = S.top_down(graph, split, int(key[len(keys)]), min_gap, resolution, allowed, pos)
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        return pd.DataFrame({**dict(zip(own, key, strict=True)), "pos": np.concatenate(pieces), "piece": piece})

    schema = ", ".join([*(f"{k} {types[k]}" for k in own), "pos int, piece int"])
    pieces = each_chain(rows, fragments.where("not done").select(*own, effort("n").alias("cost")), own, run, schema)
    whole = nodes.join(fragments.where("done").select(*own), own, "left_semi").select(*own, "pos", F.lit(0).alias("piece"))
    pieces = pieces.unionByName(whole).checkpoint()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "piece")) - 1
    names = pieces.select(*keys, "path", "piece").distinct().withColumn("label", number.cast("int"))
    return pieces.join(names, [*keys, "path", "piece"]).select(*keys, "pos", "label")
