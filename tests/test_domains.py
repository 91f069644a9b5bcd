"""The jobs against the DataFrame operators, and what must hold for any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions import splitting as S
from foldspark.jobs import domains, fixtures
from foldspark.operators import cuts, graph

SF = "/root/testdata/sf0.001"
K = ["chain_id"]


@pytest.fixture(scope="module")
def chains(spark):
    rows = fixtures.residues(spark, SF).withColumn("chain_type", F.lit("protein")).cache()
    edges = graph.contact_edges(rows, 7.5, K).cache()
    sizes = rows.groupBy(*K).agg(F.count("*").cast("int").alias("n"), F.first("chain_type").alias("chain_type"))
    return rows, edges, sizes


def local(edges, sizes):
    n = {r.chain_id: r.n for r in sizes.collect()}
    e = edges.toPandas().sort_values(["chain_id", "i", "j"])
    return {c: S.Edges(n[c], g.i.to_numpy(), g.j.to_numpy(), g.weight.to_numpy()) for c, g in e.groupby("chain_id")}


def test_first_round_equals_the_operators(chains):
    _, edges, sizes = chains
    one = {r.chain_id: r for r in cuts.best_continuous_cut(edges, sizes, K).collect()}
    two = {r.chain_id: r for r in cuts.best_discontinuous_cut(edges, sizes, K).collect()}
    for c, e in local(edges, sizes).items():
        q, at = S.continuous(e, 10, 1.0)
        assert (one[c].k + 1, one[c].q) == (at, pytest.approx(q, abs=1e-8))
        found = S.discontinuous(e, 10, 30, 1.0)
        assert (found is None) == (c not in two)
        if found:
            assert two[c].q == pytest.approx(found[0], abs=1e-8)


def test_labels_cover_every_residue(chains):
    rows, edges, sizes = chains
    labels = domains.detect_domains(rows, K)
    assert labels.count() == rows.count() and labels.where("label < 0").count() == 0
    assert labels.select("chain_id", "pos").distinct().count() == rows.count()


def test_limited_cuts(chains):
    rows, edges, sizes = chains
    allowed = cuts.cut_candidates(rows, K)
    pieces = domains.cluster_chains(edges, sizes, K, allowed, split=-1.0, merge=None, min_gap=10_000)
    starts = pieces.join(pieces.select("chain_id", (F.col("pos") + 1).alias("pos"), F.col("label").alias("left")), ["chain_id", "pos"]).where("left <> label")
    assert starts.count() > 0
    assert starts.select("chain_id", F.col("pos").alias("k")).join(allowed, ["chain_id", "k"], "left_anti").count() == 0


def test_ratio_of_pieces(chains):
    _, edges, sizes = chains
    pieces = domains.cluster_chains(edges, sizes, K, merge=None).cache()
    got = {(r.chain_id, r.label_a, r.label_b): r.ratio for r in graph.contact_ratio(edges, pieces, K).collect()}
    by_chain = local(edges, sizes)
    labels = pieces.toPandas().sort_values(["chain_id", "pos"])
    for c, g in labels.groupby("chain_id"):
        own = [np.flatnonzero(g.label.to_numpy() == k) for k in range(g.label.max() + 1)]
        held = S.Contacts(by_chain[c], own)
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                assert held.ratio(a, b, "max") == pytest.approx(got.get((c, a, b), 0.0))


def test_pvalues_are_repeatable(chains):
    _, edges, sizes = chains
    some = [r.chain_id for r in sizes.orderBy("chain_id").limit(3).collect()]
    e, s = (df.where(F.col("chain_id").isin(some)) for df in (edges, sizes))
    one, two = (sorted(map(tuple, domains.split_pvalue(e, s, K, rewirings=4).collect())) for _ in range(2))
    assert one == two and all(1 / 5 <= p <= 1 for *_, p in one)
    stopped = domains.split_pvalue(e, s, K, rewirings=4, alpha=0.1).collect()
    assert all(r.p > 0.1 for r in stopped)
