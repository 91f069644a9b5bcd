"""Keys and shared helpers of the long tables: one row for each residue, edge or label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec

#: The chain key. Every operator takes other keys too.
K = ("structure_id", "model_id", "chain_id")
Keys = Sequence[str]


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join that sorts both sides. Spark takes rows that came out of an explode or of Python for as few as
    went in, and would send a large table through the driver to broadcast it."""
    return rows.hint("shuffle_merge")


def along(keys: Keys, *order: str) -> WindowSpec:
    """Rows of one chain in order."""
    return Window.partitionBy(*keys).orderBy(*(order or ("pos",)))


def before(keys: Keys, *order: str) -> WindowSpec:
    """From the start of the chain to the row itself."""
    return along(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
