"""Work on whole chains, or fragments of chains, in tasks of alike cost.

Hashing a chain's key to a task puts several long chains into one by chance. Here the keys are dealt out by cost: the
chains that alone make up more than a small share of a task (a bounded number) and the cells into which all others are
hashed (a bounded number too) go, dearest first, to the task that has least so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Keys

#: Cells of light chains for each task, and the share of a task's cost (one over it) above which a chain is placed alone.
CELLS, SHARE = 16, 16
#: Rows of results that a task hands over together.
HANDED = 20_000


def effort(n: Column | str) -> Column:
    """Cost of splitting n residues: sorts of edges whose number grows with n."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return n * F.log2(n + 1)


def balanced(costs: list[float], tasks: int) -> list[int]:
    """A task for every cost: dearest first, each to the task that has least (the first on ties)."""
    waiting = [(0.0, t) for t in range(tasks)]
    out = [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        total, t = heapq.heappop(waiting)
        out[k] = t
        heapq.heappush(waiting, (total + costs[k], t))
    return out


def dealt(rows: DataFrame, costs: DataFrame, keys: Keys, tasks: int | None = None) -> DataFrame:
    """``rows`` in ``tasks`` partitions (as many as shuffles have), each chain in one and sorted by key. ``costs`` has
    the cost of every chain; two counts of it reach the driver: chains dearer than 1 / ``SHARE`` of a task, of which
    there are at most ``SHARE`` a task, and ``CELLS`` sums a task."""
    spark, keys = rows.sparkSession, list(keys)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64(*keys), F.lit(tasks * CELLS)).cast("int")
    costs = costs.select(*keys, F.col("cost").cast("double").alias("cost"))
    total = costs.agg(F.sum("cost")).first()[0] or 0.0
    dear = F.col("cost") > total / (tasks * SHARE)
    heavy = costs.where(dear).orderBy(*keys).collect()
    light = costs.where(~dear).groupBy(cell.alias("_cell")).agg(F.sum("cost").alias("cost")).orderBy("_cell").collect()
    placed = balanced([r.cost for r in [*heavy, *light]], tasks)
    types = dict(costs.dtypes)
    of_heavy = [(*r[: len(keys)], t) for r, t in zip(heavy, placed, strict=False)]
    of_cells = [(r["_cell"], t) for r, t in zip(light, placed[len(heavy) :], strict=True)]
    heavy = spark.createDataFrame(of_heavy, ", ".join([*(f"{k} {types[k]}" for k in keys), "_own int"]))
    light = spark.createDataFrame(of_cells, "_cell int, _shared int")
    rows = rows.withColumn("_cell", cell).join(F.broadcast(heavy), keys, "left").join(F.broadcast(light), "_cell", "left")
    rows = rows.withColumn("_task", F.coalesce("_own", "_shared", F.lit(0)))
    return rows.repartitionById(tasks, "_task").drop("_cell", "_own", "_shared", "_task").sortWithinPartitions(*keys)


def _firsts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places at which a new key begins; nulls are equal."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        values, gone = rows[k].to_numpy(), rows[k].isna().to_numpy()
        new[1:] |= (values[1:] != values[:-1]) & ~(gone[1:] & gone[:-1])
    return np.flatnonzero(new)


def each_chain(
    rows: DataFrame,
    costs: DataFrame,
    keys: Keys,
    run: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    schema: str,
    tasks: int | None = None,
) -> DataFrame:
    """``run`` on the rows of one chain at a time: a task reads its chains one after another and holds one of them."""
    keys = list(keys)

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            starts = _firsts(batch, keys).tolist()
            if held and len(_firsts(pd.concat([held[-1].tail(1), batch.head(1)])[keys], keys)) == 1:
                starts = starts[1:]
                held.append(batch.iloc[: starts[0] if starts else None])
            if starts and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            for a, b in zip(starts, [*starts[1:], None], strict=False):
                if held:
                    yield pd.concat(held, ignore_index=True)
                held = [batch.iloc[a:b]]
        if held:
            yield pd.concat(held, ignore_index=True)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, n = [], 0
        for chain in chains(batches):
            done.append(run(tuple(chain[k].iloc[:1].tolist()[0] for k in keys), chain))
            n += len(done[-1])
            if n >= HANDED:
                yield pd.concat(done, ignore_index=True)
                done, n = [], 0
        if done:
            yield pd.concat(done, ignore_index=True)

    return dealt(rows, costs, keys, tasks).mapInPandas(work, schema)
