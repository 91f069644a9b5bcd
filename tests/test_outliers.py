"""Outliers by bounds against silhouettes of all residues."""

import random

import pytest
from pyspark.sql import functions as F

from foldspark.operators import cleanup

K = ["chain_id"]


@pytest.fixture(scope="module")
def clouds(spark):
    """Chains of clusters that lie apart, touch or overlap; short clusters, linkers and coil everywhere."""
    rng = random.Random(3)
    rows = []
    for c in range(40):
        pos, apart = 0, rng.choice([2, 6, 15, 60])
        for _ in range(rng.randint(1, 7)):
            label = rng.choice([-1, 0, 1, 2, 3])
            centre = [rng.uniform(-1, 1) * apart + 5 * label for _ in range(3)]
            for _ in range(rng.choice([1, 3, 4, 5, 20, 45])):
                rows.append((c, pos, *(x + rng.gauss(0, 3) for x in centre), label, rng.choice("CCCTSHE")))
                pos += 1
    df = spark.createDataFrame(rows, "chain_id int, pos int, x double, y double, z double, label int, ss string").repartition(4)
    return df.cache()


def plain_marked(rows, silhouette, tau, expand, least):
    """Marks of one chain, residue by residue."""
    n = len(rows)
    bad = [r.label != -1 and r.ss in "CTS" and silhouette[r.pos] is not None and silhouette[r.pos] < tau for r in rows]
    starts = [k for k in range(n) if k == 0 or rows[k].label != rows[k - 1].label]
    out = [r.label for r in rows]
    for a, b in zip(starts, [*starts[1:], n]):
        if a == 0 or rows[a - 1].label != -1:
            for k in range(a, min(b, a + expand)):
                if not bad[k]:
                    break
                out[k] = -1
        if b == n or rows[b].label != -1:
            for k in range(b - 1, max(a - 1, b - 1 - expand), -1):
                if not bad[k]:
                    break
                out[k] = -1
    runs = [[v, 1] for v in out[:1]]
    for v in out[1:]:
        if v == runs[-1][0]:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    filled = []
    for k, (v, size) in enumerate(runs):
        if v == -1 and size < least and 0 < k < len(runs) - 1 and runs[k - 1][0] == runs[k + 1][0]:
            v = runs[k - 1][0]
        filled += [v] * size
    return filled


@pytest.mark.parametrize("tau, expand", [(0.1, 30), (0.4, 3), (-0.2, 10)])
def test_marks_equal_those_of_all_silhouettes(clouds, tau, expand):
    points = {(r.chain_id, r.pos): r.silhouette for r in cleanup.silhouette_points(clouds, clouds, K).collect()}
    chains = {}
    for r in clouds.orderBy("chain_id", "pos").collect():
        chains.setdefault(r.chain_id, []).append(r)
    want = {}
    for c, rows in chains.items():
        marks = plain_marked(rows, {r.pos: points[c, r.pos] for r in rows}, tau, expand, 3)
        want |= {(c, r.pos): v for r, v in zip(rows, marks)}
    got = {(r.chain_id, r.pos): r.label for r in cleanup.mark_outliers(clouds, clouds, K, tau, expand).collect()}
    assert got == want and got != {(c, r.pos): r.label for c, rows in chains.items() for r in rows}


def test_bounds_hold_and_decide_most(clouds):
    sizes, rows = cleanup._sized(clouds, clouds, K, 5)
    exact = cleanup.silhouette_points(clouds, clouds, K).where("silhouette is not null").select(*K, "pos", "silhouette")
    both = exact.join(cleanup.silhouette_bounds(rows, rows, K), [*K, "pos"])
    assert both.count() == exact.count() and both.where("silhouette < least - 1e-9 or silhouette > most + 1e-9").count() == 0
    decided = both.where("most < 0.1 or least >= 0.1").count() / both.count()
    assert decided > 0.6, decided
