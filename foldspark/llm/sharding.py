"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into ``CELLS`` equal cells. Every shard owns ``vnodes`` virtual nodes, hashed to cells; a row is hashed to
a cell and offered to the first virtual node at or after it. A full shard refuses the rest of a cell, whose rows go on
clockwise to the next shard with room. Which ranks of which cell land on which shard depends on the rows only through
the number of rows of every cell, so the plan is worked out from at most ``CELLS`` counts, whatever the table holds, and
then joined back as a table of rank intervals. With ``slack`` 0 shards hold floor or ceil of rows / shards: counts are at
most one apart (law ``rows``). Equal texts are spread like any other rows, since ids decide the place.

Rows of a cell are in the order of (part, place, id, CRC, size), where ``place`` is a hash of the id and ``part`` the
leading bits of the place and of the CRC. A window over the cell numbers them; a cell of more than ``HOT`` rows (one id,
or no id and one text, in very many rows) is numbered in its parts, which are ranges of the same order, and rows that are
equal throughout by the source partition: prefix sums over the parts give the ranks. So ranks depend neither on ``HOT``
nor on how the table is partitioned, and no task holds the rows of a hot cell.

Edge cases: a null text has no bytes (size 8, CRC of the empty text); a row without id is placed by its text's CRC.
Repeated rows are placed one by one; which of several equal rows comes first does not show. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut

CELLS = 1 << 14
#: Rows of a cell up to which one window numbers it. Larger ones are numbered in parts; ranks are the same.
HOT = 1_000_000


def _cell(*cols: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 50).cast("int")


def ring(docs: DataFrame, shards: int, vnodes: int) -> list[int]:
    """The shards in clockwise order of their virtual nodes, as (cell, shard) pairs. ``shards * vnodes`` rows."""
    nodes = docs.sparkSession.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    placed = nodes.select(_cell(F.lit("ring"), "shard", "replica").alias("cell"), F.xxhash64("shard", "replica").alias("tie"), "shard")
    return [(r.cell, r.shard) for r in placed.orderBy("cell", "tie", "shard").collect()]


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first) for every run of rows of a cell.

    ``counts`` has the rows of every cell. Rows that a full shard refuses continue clockwise, round after round.
    """
    total = sum(counts.values())
    each, over = divmod(total, shards)
    first_seen = list(dict.fromkeys(s for _, s in nodes))
    if slack:
        room = dict.fromkeys(first_seen, int(-(-total * (1 + slack) // shards)))
    else:
        room = {s: each + (i < over) for i, s in enumerate(first_seen)}
    used = dict.fromkeys(first_seen, 0)
    starts, n = [], len(nodes)
    at = 0
    cells = sorted(counts)
    for cell in cells:
        while at < n and nodes[at][0] < cell:
            at += 1
        starts.append(at % n)
    waiting = [(cell, 0, counts[cell], start) for cell, start in zip(cells, starts, strict=True)]
    out = []
    while waiting:
        refused = []
        for cell, lo, hi, at in waiting:
            steps = 0
            while not room[nodes[at][1]] and steps <= n:
                at, steps = (at + 1) % n, steps + 1
            shard = nodes[at][1]
            taken = min(hi - lo, room[shard])
            out.append((cell, lo, lo + taken, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
            if lo + taken < hi:
                refused.append((cell, lo + taken, hi, at))
        waiting = refused
    return out


def ranked(rows: DataFrame, hot: list[int]) -> DataFrame:
    """``rows`` of cells with their rank in the cell, from 0; cells in ``hot`` are numbered in parts."""
    row = ["place", "known", "id", "text_crc32", "size"]
    crowded = F.col("cell").isin(hot) if hot else F.lit(False)
    order = Window.partitionBy("cell").orderBy("part", *row, "row")
    plain = rows.where(~crowded).withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    if not hot:
        return plain
    # The partition in which monotonically_increasing_id numbered the row.
    rows = rows.where(crowded).withColumn("source", F.shiftright("row", 33).cast("int"))
    own = ["cell", "part", *row, "source"]
    until = (Window.unboundedPreceding, -1)
    groups = rows.groupBy(*own).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell", "part").orderBy(*row, "source").rowsBetween(*until)
    groups = groups.select(*own, "n", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("earlier"))
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(*until)
    parts = parts.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    groups = groups.drop("n").join(parts, ["cell", "part"])
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*own).orderBy("row")) - 1).join(groups, own)
    rows = rows.withColumn("rank", F.col("before") + F.col("earlier") + F.col("number"))
    return plain.unionByName(rows.select(*plain.columns))


def assign_shards(
    docs: DataFrame,
    shards: int = 24,
    vnodes: int = 64,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in every shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 8).cast("bigint").alias("size")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), size, F.crc32(text).alias("text_crc32"))
    place = F.coalesce("doc_id", F.col("text_crc32"))
    rows = rows.withColumns({"cell": _cell(place), "place": F.xxhash64(F.lit("rank"), place)})
    part = F.shiftrightunsigned("place", 58) * 64 + F.shiftright("text_crc32", 26)
    known = {"known": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0))}
    rows = rows.withColumns({"part": part.cast("int"), **known})
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "cells")
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    names = ("cell", "lo", "hi", "shard", "base")
    found = plan(counts, ring(docs, shards, vnodes), shards, slack)
    runs = json.dumps([dict(zip(names, run, strict=True)) for run in found])
    schema = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,base:bigint>>"
    runs = cut(spark.range(1).select(F.inline(F.from_json(F.lit(runs), schema))), "runs")
    rows = ranked(rows, [cell for cell, n in counts.items() if n > HOT])
    placed = rows.join(F.broadcast(runs), "cell").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
