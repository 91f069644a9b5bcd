"""Domains of all chains: contact graph, split, merge, labels.

Edges and allowed cuts of a chain meet in one task, chains are dealt to tasks by cost (``chains``), and chains that are too
long for one task are split in rounds over their fragments (``fragments``). Merging holds one chain: its memory is linear in
the chain's edges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splitting as S
from ..operators.chains import each_chain, effort
from ..operators.cuts import MIN_GAP, cut_candidates
from ..operators.graph import contact_edges, cutoff_for
from ..schemas import K, Keys
from .fragments import LONGEST, least_length, split_long


def _graph(rows: pd.DataFrame, n: int) -> S.Edges:
    rows = rows[rows["kind"] == 1].sort_values(["i", "j"])
    return S.Edges(n, rows["i"].to_numpy(np.int64), rows["j"].to_numpy(np.int64), rows["weight"].to_numpy(float))


def _gathered(edges: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes (kind 0: n in i, least length in j) and edges (kind 1) of chains in one table. Edges of chains without a
    size, and chains without an edge, are there too."""
    sites = sizes.select(*keys, F.lit(0).alias("kind"), F.col("n").cast("int").alias("i"), least_length(F.col("chain_type")).alias("j"), F.lit(0.0).alias("weight"))
    return sites.unionByName(edges.select(*keys, F.lit(1).alias("kind"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("weight").cast("double").alias("weight")))


def _site(rows: pd.DataFrame) -> tuple[int, int]:
    """Size and least length of a chain."""
    site = rows[rows["kind"] == 0]
    return (int(site["i"].max()), int(site["j"].min())) if len(site) else (0, 0)


def cluster_chains(
    edges: DataFrame,
    sizes: DataFrame,
    keys: Keys = K,
    cuts: DataFrame | None = None,
    split: float = 0.4,
    merge: float | None = 0.2,
    resolution: float = 1.0,
    weighted: bool | None = None,
    mode: str = "max",
    size_first: bool = False,
    wanted: int | None = None,
    min_gap: int = MIN_GAP,
    longest: int = LONGEST,
) -> DataFrame:
    """pos, label of every residue. ``sizes`` has n and chain_type; ``cuts`` has k for chains whose cuts are limited.

    Without cuts all edges count 1, with them their weights count; ``weighted`` overrides both. ``merge`` None stops
    after splitting. Chains of more than ``longest`` residues are split in rounds over their fragments, with equal labels.
    """
    keys = list(keys)
    if weighted is None and cuts is not None:
        # Chains with a row of k, be it -1, are limited to their cuts even if none fits.
        some = cuts.select(*keys).distinct().withColumn("_limited", F.lit(True))
        counted = edges.join(some, keys, "left").withColumn("weight", F.when(F.col("_limited"), F.col("weight")).otherwise(1.0)).drop("_limited")
    else:
        counted = edges if weighted else edges.withColumn("weight", F.lit(1.0))
    counted = counted.select(*keys, "i", "j", "weight")
    types = dict(sizes.select(*keys).dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "pos int", "label int"])
    join = S.bottom_up_size_first if size_first else S.bottom_up

    def labelled(key: tuple, n: int, pieces: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "pos": np.arange(n), "label": S.labels_of(n, pieces)})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, least = _site(rows)
        if not n:
            return pd.DataFrame({c: [] for c in [*keys, "pos", "label"]})
        graph = _graph(rows, n)
        sites = rows.loc[rows["kind"] == 2, "i"].to_numpy(np.int64)
        pieces = S.top_down(graph, split, least, min_gap, resolution, sites if len(sites) else None)
        return labelled(key, n, pieces if merge is None else join(graph, pieces, merge, mode, wanted))

    short = sizes.where(F.col("n") <= longest)
    rows = _gathered(counted, short, keys)
    if cuts is not None:
        rows = rows.unionByName(cuts.select(*keys, F.lit(2).alias("kind"), F.col("k").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("weight")))
    long = sizes.where(F.col("n") > longest)
    if long.isEmpty():
        return each_chain(rows, sizes.select(*keys, effort("n").alias("cost")), keys, run, schema)
    rows = rows.join(long.select(*keys), keys, "left_anti")
    done = each_chain(rows, short.select(*keys, effort("n").alias("cost")), keys, run, schema)
    own = counted.join(long.select(*keys), keys, "left_semi")
    pieces = split_long(own, long, keys, cuts, split, min_gap, resolution, longest)
    if merge is None:
        return done.unionByName(pieces)

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, _ = _site(rows)
        held = rows[rows["kind"] == 2].sort_values(["j", "i"])
        pos, label = held["i"].to_numpy(np.int64), held["j"].to_numpy()
        pieces = np.split(pos, np.flatnonzero(label[1:] != label[:-1]) + 1)
        return labelled(key, n, join(_graph(rows, n), pieces, merge, mode, wanted))

    rows = _gathered(own, long, keys).unionByName(pieces.select(*keys, F.lit(2).alias("kind"), F.col("pos").alias("i"), F.col("label").alias("j"), F.lit(0.0).alias("weight")))
    return done.unionByName(each_chain(rows, long.select(*keys, effort("n").alias("cost")), keys, merged, schema))


def detect_domains(residues: DataFrame, keys: Keys = K, ss: bool = False, split: float = 0.4, merge: float = 0.2, resolution: float = 1.0, cutoff: float | None = None, weighted: bool = True, weighted_modularity: bool | None = None) -> DataFrame:
    """pos, label of every residue of chains with pos, x, y, z and chain_type; with ``ss`` cuts are limited by the
    column ss of protein chains."""
    limit = F.lit(cutoff) if cutoff else cutoff_for(F.col("chain_type"))
    edges = contact_edges(residues, limit, keys, weighted)
    sizes = residues.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.first("chain_type").alias("chain_type"))
    cuts = cut_candidates(residues.where("chain_type = 'protein'"), keys) if ss else None
    return cluster_chains(edges, sizes, keys, cuts, split, merge, resolution, weighted_modularity)


#: Rewirings that one task tries for a chain.
BATCH = 5


def hits_needed(rewirings: int, alpha: float | None) -> int | None:
    """With how many rewirings that reach q the p-value exceeds ``alpha``; None: never, or nobody asks."""
    if alpha is None:
        return None
    return next((h for h in range(rewirings + 1) if (h + 1) / (rewirings + 1) > alpha), None)


def rewired_scores(edges: DataFrame, sizes: DataFrame, keys: Keys = K, rewirings: int = 10, swap_mult: int = 5, alpha: float | None = None, resolution: float = 1.0, weighted: bool = True, min_gap: int = MIN_GAP, seed: int = 0, batch: int = BATCH) -> DataFrame:
    """For every chain and batch of rewirings: q of the chain's best split, hits (rewired graphs that reach q) and tried.

    Batches of a chain run in tasks of their own; seeds come from the key and the rewiring's number, so the batches' size
    changes nothing. A batch stops once its own hits take the p-value above ``alpha``, and chains without a split try
    none."""
    keys = list(keys)
    types = dict(sizes.select(*keys).dtypes)
    own = [*keys, "batch"]
    need = hits_needed(rewirings, alpha)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, least = _site(rows)
        graph, number = _graph(rows, n), int(key[-1])
        found = S.best_split(graph, np.arange(n), least, min_gap, resolution, None) if n and len(graph.i) else None
        hits = tried = 0
        # With no hit needed the p-value is known after the first rewiring.
        last = min(rewirings, (number + 1) * batch) if need != 0 else min(rewirings, 1)
        for r in range(number * batch, last) if found else ():
            rng = np.random.default_rng([seed, r, zlib.crc32(repr(list(key[:-1])).encode())])
            other = S.best_split(S.rewired(graph, max(1, swap_mult * len(graph.i)), rng), np.arange(n), least, min_gap, resolution, None)
            tried += 1
            hits += other is not None and other[0] >= found[0] - 1e-12
            if need and hits >= need:
                break
        return pd.DataFrame({**{k: [v] for k, v in zip(own, key, strict=True)}, "q": [found[0] if found else np.nan], "hits": [hits], "tried": [tried]})

    counted = edges if weighted else edges.withColumn("weight", F.lit(1.0))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-rewirings // batch) - 1)))).alias("batch")
    rows = _gathered(counted, sizes, keys).select("*", numbers)
    costs = sizes.select(*keys, effort("n").alias("cost"), numbers)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "batch int", "q double", "hits int", "tried int"])
    scores = each_chain(rows, costs, own, run, schema)
    return scores.withColumn("q", F.when(~F.isnan("q"), F.col("q")))


def split_pvalue(edges: DataFrame, sizes: DataFrame, keys: Keys = K, rewirings: int = 10, swap_mult: int = 5, alpha: float | None = None, resolution: float = 1.0, weighted: bool = True, min_gap: int = MIN_GAP, seed: int = 0, batch: int = BATCH) -> DataFrame:
    """q of each chain's best split and its p-value over ``rewirings`` rewired graphs (1 without a split).

    With ``alpha`` the count stops at the first rewiring whose bound exceeds it: as hits come one by one, p is then
    known, whichever rewirings bring them.
    """
    scores = rewired_scores(edges, sizes, keys, rewirings, swap_mult, alpha, resolution, weighted, min_gap, seed, batch)
    per = scores.groupBy(*keys).agg(F.max("q").alias("q"), F.sum("hits").alias("hits"))
    need = hits_needed(rewirings, alpha)
    counted = F.least("hits", F.lit(need)) if need else F.col("hits")
    return per.select(*keys, "q", F.when(F.col("q").isNull(), 1.0).otherwise((counted + 1) / F.lit(rewirings + 1)).alias("p"))
