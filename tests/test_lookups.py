"""Look-up operators on cases that the given tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

import foldspark.queries  # noqa: F401
from foldspark import registry
from foldspark.jobs.fixtures import residues
from foldspark.operators import lookups
from foldspark.schemas import K

from .test_queries import SF


def test_overlap_components_of_long_paths(spark):
    n, numbers = 200, list(range(200))
    random.Random(5).shuffle(numbers)
    rows = [("s", 1, "A", i, i + e) for i in range(n) for e in (0, 1)]  # cluster i shares a member with i + 1
    rows += [("s", 1, None, numbers[i], i + e) for i in range(n) for e in (0, 1)]
    rows += [("s", 1, "B", 7, 1), ("s", 1, "B", 3, 2), ("s", 1, "B", 3, 2)]  # no overlap
    clusters = spark.createDataFrame(rows, "structure_id string, model_id int, chain_id string, cluster int, member int")
    got = lookups.overlap_components(clusters, K, drop_isolated=False)
    found = {r.chain_id: (r.n, r.members) for r in got.groupBy("chain_id").agg(F.count_distinct("component").alias("n"), F.count("*").alias("members")).collect()}
    assert found == {"A": (1, n + 1), None: (1, n + 1), "B": (2, 2)}
    assert {(r.component, r.member) for r in got.where("chain_id = 'B'").collect()} == {(7, 1), (3, 2)}
    left = lookups.overlap_components(clusters, K).collect()
    assert len(left) == 2 * (n + 1) and {(r.chain_id, r.component) for r in left} == {("A", 0), (None, 0)}


@pytest.mark.parametrize("name", ["segment_of_whole", "asof_bounds_below_whole", "asof_bounds_above_whole", "asof_floor_whole"])
def test_look_ups_ask_for_every_residue(spark, name):
    asked = registry.QUERIES[name](spark, SF).select("chain_id", "value")
    assert sorted(asked.collect()) == sorted(residues(spark, SF).select("chain_id", "pos").collect())


def test_codes_are_aligned_to_the_own_length(spark):
    want = {r.chain_id: r["count"] for r in residues(spark, SF).groupBy("chain_id").count().collect()}
    assert {r.chain_id: len(r.aligned) for r in registry.QUERIES["align_ss_whole"](spark, SF).collect()} == want
