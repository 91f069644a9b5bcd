"""Densities with far pairs left out, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from foldspark.operators import graph

K = ["chain_id"]


@pytest.fixture(scope="module")
def walk(spark):
    """Long chains that wander: most pairs are far apart."""
    rng, rows = random.Random(2), []
    for c in range(4):
        at = [0.0, 0.0, 0.0]
        for k in range(500):
            at = [x + rng.gauss(0.4, 2.2) for x in at]
            rows.append((c, k, *at, k // 60 % 4))
    return spark.createDataFrame(rows, "chain_id int, pos int, x double, y double, z double, label int").repartition(3).cache()


@pytest.mark.parametrize("tolerance", [1e-3, 1e-9])
def test_error_is_within_the_bound(walk, tolerance):
    n = 125
    exact = {(r.chain_id, r.label_a, r.label_b): r.density for r in graph.inter_domain_density(walk.drop("label"), walk, K).collect()}
    near = {(r.chain_id, r.label_a, r.label_b): r.density for r in graph.inter_domain_density(walk.drop("label"), walk, K, tolerance=tolerance).collect()}
    assert near.keys() <= exact.keys() and len(near) > 4
    for key, d in exact.items():
        assert -1e-9 <= d - near.get(key, 0.0) <= tolerance * n * n * 4 * (60 * 60) ** -0.43
    whole = {(r.chain_id, r.label): r.density for r in graph.intra_domain_density(walk.drop("label"), walk, K).collect()}
    part = {(r.chain_id, r.label): r.density for r in graph.intra_domain_density(walk.drop("label"), walk, K, tolerance=tolerance).collect()}
    assert whole.keys() == part.keys()
    for key, d in whole.items():
        assert -1e-9 <= d - part[key] <= tolerance * n * n * 2 * 60**-0.95


def test_near_pairs_are_those_of_all_pairs(walk):
    cutoff = graph.reach(1e-6)
    d = graph.distance("a", "b")
    want = graph._pairs(walk, K, 64).where(d < cutoff).select("chain_id", "i", "j")
    pairs = graph._near_pairs(walk, K, cutoff).select("chain_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    assert pairs.count() < 0.6 * graph._pairs(walk, K, 64).count()


def test_weights_beyond_the_reach_are_below_the_tolerance(spark):
    for tolerance in (0.4, 1e-3, 1e-12):
        w = spark.range(1).select(graph.contact_weight(F.lit(graph.reach(tolerance)))).first()[0]
        assert w == pytest.approx(tolerance, rel=1e-6)
