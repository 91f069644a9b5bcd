"""Long chains in rounds, tasks of alike cost, p-values in batches."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from foldspark.jobs import domains, fixtures, fragments
from foldspark.operators import chains, cuts, graph

SF = "/root/testdata/sf0.001"
K = ["chain_id"]


@pytest.fixture(scope="module")
def events(spark):
    rows = fixtures.residues(spark, SF).withColumn("chain_type", F.when(F.col("chain_id") % 5 == 0, "RNA").otherwise("protein")).cache()
    sizes = rows.groupBy(*K).agg(F.count("*").cast("int").alias("n"), F.first("chain_type").alias("chain_type"))
    return rows, graph.contact_edges(rows, 7.5, K).cache(), sizes


@pytest.fixture(scope="module")
def items(spark):
    rows = fixtures.long_residues(spark, SF).withColumn("chain_type", F.lit("protein")).cache()
    sizes = rows.groupBy(*K).agg(F.count("*").cast("int").alias("n"), F.first("chain_type").alias("chain_type"))
    return rows, graph.contact_edges(rows, 7.5, K).cache(), sizes


def labels(df):
    return sorted(map(tuple, df.select("chain_id", "pos", "label").collect()))


@pytest.mark.parametrize("longest", [0, 45])
def test_rounds_give_the_labels_of_the_recursion(events, longest):
    _, edges, sizes = events
    whole = labels(domains.cluster_chains(edges, sizes, K, split=0.2, merge=None))
    assert labels(domains.cluster_chains(edges, sizes, K, split=0.2, merge=None, longest=longest)) == whole
    assert len({(c, k) for c, _, k in whole}) > 1.5 * len({c for c, *_ in whole})


def test_rounds_of_very_long_chains_with_merging(items):
    _, edges, sizes = items
    longest = sizes.agg(F.max("n")).first()[0] // 3
    assert sizes.where(F.col("n") > longest).count()
    assert labels(domains.cluster_chains(edges, sizes, K, longest=longest)) == labels(domains.cluster_chains(edges, sizes, K))
    one, two = (labels(domains.cluster_chains(edges, sizes, K, split=0.1, merge=0.5, mode="min", size_first=True, longest=x)) for x in (longest, 10**6))
    assert one == two


def test_rounds_with_limited_cuts(events):
    rows, edges, sizes = events
    # Some chains are limited to places, some to none, the others are free.
    allowed = cuts.cut_candidates(rows, K).where("chain_id % 3 = 0")
    none = sizes.where("chain_id % 3 = 1").select("chain_id", F.lit(-1).alias("k"))
    allowed = allowed.select("chain_id", F.col("k").cast("int").alias("k")).unionByName(none)
    whole = labels(domains.cluster_chains(edges, sizes, K, allowed, split=0.2, merge=None))
    assert labels(domains.cluster_chains(edges, sizes, K, allowed, split=0.2, merge=None, longest=0)) == whole


def test_chains_are_dealt_out_by_cost(spark):
    rng = random.Random(0)
    lengths = [int(rng.paretovariate(0.9) * 5) for _ in range(4000)]
    lengths = [min(n, 20_000) for n in lengths]
    rows = [(f"c{k}", n) for k, n in enumerate(lengths)]
    costs = spark.createDataFrame(rows, "chain_id string, n int").withColumn("cost", chains.effort("n"))

    def run(key, rows):
        assert len(rows) == 2
        return pd.DataFrame({"chain_id": key[:1], "task": [TaskContext.get().partitionId()]})

    twice = costs.select("chain_id", "n").unionByName(costs.select("chain_id", "n"))
    got = dict(map(tuple, chains.each_chain(twice, costs, K, run, "chain_id string, task int", tasks=8).collect()))
    assert len(got) == len(rows)
    load = np.zeros(8)
    for chain, n in rows:
        load[got[chain]] += n * np.log2(n + 1)
    assert load.max() <= 1.3 * load.mean() and load.min() > 0


def test_a_chain_of_a_third_of_all_residues_is_cut_into_tasks(spark):
    """One chain outweighs the others: in rounds, no task of the recursion gets more than ``longest`` residues of it."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    third = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id") + 1)
    order = F.row_number().over(fragments.Window.partitionBy("chain_id").orderBy("event_id")) - 1
    rows = events.select(third.alias("chain_id"), "event_id", "value").where("event_id < 9000").withColumn("pos", order.cast("int"))
    rows = fixtures._lattice(rows, F.col("value") - F.floor("value")).withColumn("chain_type", F.lit("protein")).cache()
    edges = graph.contact_edges(rows, 7.5, K).cache()
    sizes = rows.groupBy(*K).agg(F.count("*").cast("int").alias("n"), F.first("chain_type").alias("chain_type"))
    n = {r.chain_id: r.n for r in sizes.collect()}
    assert n[0] > sum(n.values()) / 4
    assert labels(domains.cluster_chains(edges, sizes, K, longest=400)) == labels(domains.cluster_chains(edges, sizes, K))


def test_keys_with_nulls_stay_whole(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", 4), ("b", 5)], "chain_id string, v int")
    costs = rows.groupBy("chain_id").agg(F.count("*").alias("cost"))
    got = chains.each_chain(rows, costs, K, lambda key, g: pd.DataFrame({"n": [len(g)], "total": [int(g["v"].sum())]}), "n int, total int", tasks=3)
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 4), (2, 6)]
    assert chains.each_chain(rows.limit(0), costs.limit(0), K, lambda key, g: g, "chain_id string, v int").collect() == []


def test_chains_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).select((F.col("id") % 3).alias("chain_id"), F.col("id").alias("v"))
        costs = rows.groupBy("chain_id").agg(F.count("*").alias("cost"))
        got = chains.each_chain(rows, costs, K, lambda key, g: pd.DataFrame({"c": key, "n": [len(g)]}), "c bigint, n int", tasks=2)
        assert sorted(map(tuple, got.collect())) == [(0, 34), (1, 33), (2, 33)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alpha_saves_rewirings_and_keeps_p(events):
    _, edges, sizes = events
    some = [r.chain_id for r in sizes.orderBy("chain_id").limit(6).collect()]
    e, s = (df.where(F.col("chain_id").isin(some)) for df in (edges, sizes))
    tried = lambda alpha, batch=3: domains.rewired_scores(e, s, K, 8, alpha=alpha, batch=batch).agg(F.sum("tried")).first()[0]
    full = {r.chain_id: r.p for r in domains.split_pvalue(e, s, K, 8, batch=3).collect()}
    assert full == {r.chain_id: r.p for r in domains.split_pvalue(e, s, K, 8, batch=8).collect()}
    for alpha in (0.05, 0.12, 0.3, 0.5):
        stopped = {r.chain_id: r.p for r in domains.split_pvalue(e, s, K, 8, alpha=alpha, batch=3).collect()}
        one = {r.chain_id: r.p for r in domains.split_pvalue(e, s, K, 8, alpha=alpha, batch=8).collect()}
        assert stopped == one
        # Below alpha nothing changes; above it p is that of the first rewiring that takes it there.
        assert all(stopped[c] == p if p <= alpha else alpha < stopped[c] <= p for c, p in full.items())
    assert tried(0.05) <= len(some) < tried(None) == 8 * sum(p is not None for p in full.values()) or tried(None) < 8 * len(some)
    assert tried(0.12) <= tried(None)
