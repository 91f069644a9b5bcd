"""Running values along a chain: the value before, the last one seen, and sums.

One window does it with one task a chain. With ``places`` a chain is cut into blocks of so many places, each a task of
its own; a block's last values and sum make a row of a small table, a window over the blocks turns these into what each
block starts with, and a join brings that to its rows. Results are the same. Keys and the place in the order are
numbers of any sign; rows without a place are put into no block and see their chain's start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Keys


def scanned(
    rows: DataFrame,
    keys: Keys,
    order: str = "pos",
    places: int | None = None,
    *,
    then: Sequence[str] = (),
    backward: bool = False,
    lag: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """``rows`` with, for each name: in ``lag`` the value of the row before, in ``last`` the last value that is not null
    up to the row, in ``total`` the sum up to the row; along ``order`` (from its end if ``backward``), then ``then``."""
    lag, last, total = lag or {}, last or {}, total or {}
    along = [F.col(order).desc() if backward else F.col(order).asc(), *(F.col(c).asc() for c in then)]
    if places is None:
        w = Window.partitionBy(*keys).orderBy(*along)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = {n: F.lag(c).over(w) for n, c in lag.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
        return rows.withColumns(new | {n: F.sum(c).over(upto) for n, c in total.items()})
    sign = -1 if backward else 1
    given = {f"_v_{n}": c for n, c in (lag | last | total).items()}
    rows = rows.withColumns(given | {"_scan_at": F.col(order) * sign})
    rows = rows.withColumn("_scan_block", F.floor(F.col("_scan_at") / places))
    place = F.struct("_scan_at", *then)
    w = Window.partitionBy(*keys, "_scan_block").orderBy("_scan_at", *then)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda n: F.struct(F.col(f"_v_{n}").alias("v"))
    some = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), held(n))
    ends = [F.max_by(held(n), place).alias(f"_c_{n}") for n in lag]
    ends += [F.max_by(some(n), F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_c_{n}") for n in last]
    ends += [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in total]
    blocks = rows.groupBy(*keys, "_scan_block").agg(*ends)
    over = Window.partitionBy(*keys).orderBy("_scan_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{n}": F.lag(f"_c_{n}").over(over) for n in lag}
    carried |= {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in last}
    carried |= {f"_c_{n}": F.sum(f"_c_{n}").over(before) for n in total}
    own = [*keys, "_scan_block"]
    blocks = blocks.withColumns(carried).select(*(F.col(c).alias(f"_k_{c}") for c in own), *carried)
    inside = {f"_i_{n}": F.lag(held(n)).over(w) for n in lag} | {f"_i_{n}": F.last(some(n), ignorenulls=True).over(upto) for n in last}
    inside |= {f"_i_{n}": F.sum(f"_v_{n}").over(upto) for n in total}
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in own))
    rows = rows.withColumns(inside).join(blocks, same, "left")
    new = {n: F.coalesce(f"_i_{n}", f"_c_{n}")["v"] for n in (*lag, *last)}
    for n in total:
        found = F.col(f"_i_{n}").isNotNull() | F.col(f"_c_{n}").isNotNull()
        new[n] = F.when(found, F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)))
    spare = [c for c in rows.columns if c.startswith(("_v_", "_c_", "_i_", "_k_"))]
    return rows.withColumns(new).drop(*spare, "_scan_at", "_scan_block")
