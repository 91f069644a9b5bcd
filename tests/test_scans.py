"""Running values of chains cut into blocks against one window a chain."""

import random

import pytest
from pyspark.sql import functions as F

from foldspark.operators import intervals, lookups
from foldspark.operators.scans import scanned

K = ["chain_id"]


@pytest.fixture(scope="module")
def chains(spark):
    rng, rows = random.Random(1), []
    for c in (1, 2, 3, None):
        pos, label = rng.randint(-40, 40), 0
        for _ in range(rng.choice([1, 30, 300])):
            pos += rng.choice([1, 1, 1, 2, 25])
            label = rng.choice([-1, 0, 1, None]) if rng.random() < 0.2 else label
            rows.append((c, pos, label, pos + 1, f"{abs(pos) - rng.randint(0, 1)}"))
    schema = "chain_id int, pos int, label int, res_num int, res_label string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("places", [1, 7, 10_000])
def test_blocks_change_nothing(chains, backward, places):
    asked = {"lag": {"p": F.col("label")}, "last": {"s": F.col("label")}, "total": {"t": F.col("label")}, "backward": backward}
    assert rows(scanned(chains, K, "pos", places, **asked)) == rows(scanned(chains, K, "pos", **asked))


@pytest.mark.parametrize("places", [1, 7, 100])
def test_operators_by_blocks(chains, places):
    whole = chains.where("chain_id is not null")
    for f in (intervals.label_runs, intervals.labelled_ranges, intervals.domain_points, intervals.internal_linkers, intervals.ranges_with_insertions, intervals.forward_fill_labels):
        for given in (chains, whole):
            assert rows(f(given, K, places=places)) == rows(f(given, K)), f.__name__
    values = whole.select("chain_id", F.col("pos").alias("value"))
    ranges = whole.where("pos % 3 = 0").select("chain_id", F.col("pos").alias("start"), (F.col("pos") + 11).alias("end"))
    for f in (lookups.asof_bounds_below, lookups.asof_bounds_above):
        assert rows(f(values, ranges, K, places=places)) == rows(f(values, ranges, K)), f.__name__
    elements = ranges.select("chain_id", F.col("start").alias("element"), F.col("end").alias("idx"))
    assert rows(lookups.asof_floor(values, elements, K, places=places)) == rows(lookups.asof_floor(values, elements, K))


def test_a_chain_is_more_than_one_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(5000).select(F.lit(1).alias("chain_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 3).alias("v"))
        found = scanned(one, K, "pos", 500, total={"t": F.col("v")})
        tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) > 1 and max(r["count"] for r in tasks) < 5000
        assert found.where("pos = 4999").first().t == sum(k % 3 for k in range(5000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
