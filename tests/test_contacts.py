"""Contacts: pairs against brute force, and plans that send no table of contacts through the driver."""

import os
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__

from foldspark.functions import nearby
from foldspark.jobs.fixtures import long_residues
from foldspark.operators import graph

DATA = "/root/testdata/sf0.001"


def broadcast(plan):
    """The sides of joins that are broadcast, as text."""
    if plan.getClass().getSimpleName() == "BroadcastHashJoinExec":
        yield (plan.right() if plan.buildSide().toString() == "BuildRight" else plan.left()).toString()
    children = plan.children()
    for k in range(children.size()):
        yield from broadcast(children.apply(k))


#: Queries in whose joins contacts, or rows of residues beside them, take part.
JOINED = ["contact_edges", "node_degree", "bipartition_modularity", "boundary_nodes", "contact_ratio", "best_continuous_cut", "best_continuous_cut_ss", "best_discontinuous_cut", "terminal_low_degree", "top_down", "detect_domains", "top_down_ss", "split_pvalue", "bottom_up", "bottom_up_size_first", "detect_domains_ss"]


@pytest.mark.parametrize("name", JOINED)
def test_no_contacts_are_broadcast(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan()
    # One row a chain is fewer than Spark takes it for.
    sides = [x for x in broadcast(plan) if not re.match(r"HashAggregate\(keys=\[chain_id#\d+L\], ", x)]
    assert not [x for x in sides if "Generate" in x or "MapInArrow" in x or "Window" in x]


def test_contacts_are_those_of_all_pairs(spark):
    """Chains over many blocks, on both sides of zero, and points on the blocks' faces."""
    rng = np.random.default_rng(5)
    chains = {"a": rng.uniform(-40, 40, (400, 3)), "b": rng.integers(-4, 5, (120, 3)) * 8.0 * 2.5, "c": rng.uniform(1e6, 1e6 + 30, (90, 3))}
    rows = [(k, pos, *map(float, p)) for k, points in chains.items() for pos, p in enumerate(points)]
    rows += [("d", 0, None, 0.0, 0.0), ("d", 1, float("nan"), 0.0, 0.0), ("d", 2, 0.0, 0.0, 0.0), (None, 0, 0.0, 0.0, 0.0), (None, 5, 1.0, 0.0, 0.0)]
    given = spark.createDataFrame(rows, "chain_id string, pos int, x double, y double, z double")
    got = sorted((r.chain_id, r.i, r.j) for r in graph.contact_edges(given, 2.5, ["chain_id"]).collect() if r.chain_id)
    want = [("d", 0, 1), ("d", 1, 2)]
    for k, p in chains.items():
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        want += [(k, i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if j == i + 1 or d[i, j] < 2.5]
    assert got == sorted(want) and len(got) > 600
    assert graph.contact_edges(given.where("chain_id is null"), 2.5, ["chain_id"]).select("i", "j").collect() == [(0, 5)]


def test_blocks_stay_whole_and_pairs_come_in_parts():
    first = [1, 2, 3, 1, 1, 2, 1, 2, 3, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"first": first[a : a + 2]}) for a in range(0, len(first), 2)]
    parts = [t.column("first").to_pylist() for t in nearby.whole_blocks(batches, "first", 3)]
    assert sum(parts, []) == first and all(p == [] or p[0] == 1 for p in parts) and len([p for p in parts if p]) > 2
    points = np.random.default_rng(1).uniform(0, 8, (300, 3))
    block, cut, own = np.repeat([4, 9], 150), np.full(300, 1.0), np.arange(300) % 3 > 0
    whole, split = ([(min(a, b), max(a, b)) for x in nearby.near(points, block, cut, own, n) for a, b in zip(x[0].tolist(), x[1].tolist(), strict=True)] for n in (10**6, 7))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert sorted(whole) == sorted(split) == [(i, j) for i in range(300) for j in range(i + 1, 300) if block[i] == block[j] and (own[i] or own[j]) and d[i, j] < 1]


def test_residues_are_shuffled_once_for_all_contacts(spark):
    """The branch of the near pairs and that of the neighbours along the chain read one exchange, weights asked for or not."""
    edges = graph.contact_edges(long_residues(spark, DATA), 7.5, ["chain_id"]).select("chain_id", "i", "j")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan and plan.count("Scan parquet") == 1
