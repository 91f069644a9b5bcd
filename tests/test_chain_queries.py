"""Queries of splitting, merging and clean-up over all chains, against plain definitions on rows read by DuckDB."""

import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from foldspark import registry
from foldspark.functions import splitting as S
from foldspark.operators import cleanup
from foldspark.queries.graph import _CUTS
from foldspark.queries.labels import post_processing
from foldspark.queries.sql import EDGES

from .oracle import duck_rows
from .test_splitting import fragment_modularity, plain_ratio

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graphs():
    """chain -> (edges with weights, allowed cuts)."""
    rows, sizes, cuts = {}, {}, {}
    for chain, i, j, w, n in duck_rows(EDGES + " select ew.*, n.n from ew join n using (chain_id)", SF)[2]:
        rows.setdefault(chain, []).append((i, j, w))
        sizes[chain] = n
    for chain, k in duck_rows(_CUTS + " select chain_id, k from cuts", SF)[2]:
        cuts.setdefault(chain, set()).add(k)
    out = {}
    for chain, edges in rows.items():
        i, j, w = zip(*sorted(edges), strict=True)
        out[chain] = S.Edges(sizes[chain], np.array(i), np.array(j), np.array(w)), cuts.get(chain, set())
    return out


def unweighted(e):
    return S.Edges(e.n, e.i, e.j, np.ones(len(e.i)))


def plain_split(e, nodes, cuts=None, least=10, gap=30):
    """(q, A, B) of the best split of ``nodes``, by trying every cut and every middle piece that an edge closes."""
    n, best = len(nodes), None
    place = {x: k for k, x in enumerate(nodes)}
    tried = []
    for k in range(least, n - least + 1):
        if cuts is None or nodes[0] + k in cuts and nodes[0] + k <= nodes[-1]:
            tried.append((nodes[:k], nodes[k:]))
    pairs = ((place.get(i), place.get(j)) for i, j in zip(e.i.tolist(), e.j.tolist(), strict=True))
    for t, v in sorted(p for p in pairs if None not in p):
        middle = v - t
        if t + 1 >= least and v - t >= max(gap, 1 + least) and n - v - 1 >= least and middle >= least and n - middle >= least:
            tried.append((nodes[: t + 1] + nodes[v + 1 :], nodes[t + 1 : v + 1]))
    for a, b in tried if n >= 2 * least else []:
        q = fragment_modularity(e, nodes, b, 1.0)
        if best is None or q > best[0]:
            best = (q, a, b)
    return best


def plain_pieces(e, nodes, threshold, cuts=None):
    best = plain_split(e, nodes, cuts)
    if best is None or best[0] < threshold:
        return [nodes]
    return [p for part in best[1:] for p in plain_pieces(e, part, threshold, cuts)]


def neighbours(e):
    near = {x: set() for x in range(e.n)}
    for i, j in zip(e.i.tolist(), e.j.tolist(), strict=True):
        near[i].add(j)
        near[j].add(i)
    return near


def plain_merge(e, pieces, ratio=0.2):
    """Join the pair of largest contact ratio, the first on ties, while it reaches ``ratio``."""
    near = neighbours(e)
    while len(pieces) > 1:
        pairs = [(a, b) for a in range(len(pieces)) for b in range(a + 1, len(pieces))]
        a, b = max(pairs, key=lambda p: (plain_ratio(near, pieces[p[0]], pieces[p[1]], "max"), -p[0], -p[1]))
        if plain_ratio(near, pieces[a], pieces[b], "max") < ratio:
            break
        pieces = [p for k, p in enumerate(pieces) if k not in (a, b)] + [sorted(pieces[a] + pieces[b])]
    return pieces


def plain_merge_by_size(e, pieces, wanted=2, ratio=0.2):
    """The smallest piece that has partners joins its smallest; below ``ratio`` the smallest joins its best."""
    near, key = neighbours(e), lambda p: (len(p), min(p))
    joined = lambda a, b: [p for p in pieces if p is not a and p is not b] + [sorted(a + b)]
    while len(pieces) > wanted:
        found = ((a, [b for b in pieces if b is not a and plain_ratio(near, a, b, "min") >= ratio]) for a in sorted(pieces, key=key))
        a, partners = next((f for f in found if f[1]), (None, []))
        if not partners:
            break
        pieces = joined(a, min(partners, key=key))
    while len(pieces) > wanted:
        a = min(pieces, key=key)
        others = [p for p in pieces if p is not a]
        pieces = joined(a, min(others, key=lambda p: (-round(plain_ratio(near, a, p, "min"), 12), *key(p))))
    return pieces


PLAIN = {
    "top_down": lambda e, cuts: plain_pieces(unweighted(e), list(range(e.n)), 0.4),
    "top_down_ss": lambda e, cuts: plain_pieces(e, list(range(e.n)), 0.4, cuts or None),
    "bottom_up": lambda e, cuts: plain_merge(e, plain_pieces(unweighted(e), list(range(e.n)), 0.3)),
    "bottom_up_size_first": lambda e, cuts: plain_merge_by_size(e, plain_pieces(unweighted(e), list(range(e.n)), 0.3)),
    "detect_domains": lambda e, cuts: plain_merge(e, plain_pieces(unweighted(e), list(range(e.n)), 0.4)),
    "detect_domains_ss": lambda e, cuts: plain_merge(e, plain_pieces(e, list(range(e.n)), 0.4, cuts or None)),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_clusters_of_every_chain(spark, graphs, name):
    got = {(r.chain_id, r.pos): r.label for r in registry.QUERIES[name](spark, SF).collect()}
    want = {(c, x): k for c, (e, cuts) in graphs.items() for k, piece in enumerate(PLAIN[name](e, cuts)) for x in piece}
    assert got == want and len(set(want.values())) > 1


def test_split_pvalue_of_every_chain(spark, graphs):
    """q by trying every split; p counts the rewired graphs, drawn from the same seeds, that split as well."""
    got = {r.chain_id: r for r in registry.QUERIES["split_pvalue"](spark, SF).collect()}
    assert set(got) == set(graphs)
    for chain, (e, _) in graphs.items():
        best = plain_split(e, list(range(e.n)))
        if best is None:
            assert got[chain].q is None and got[chain].p == 1.0
            continue
        assert got[chain].q == pytest.approx(best[0], abs=1e-8)
        hits = 0
        for r in range(10):
            rng = np.random.default_rng([0, r, zlib.crc32(repr([chain]).encode())])
            other = plain_split(S.rewired(e, 5 * len(e.i), rng), list(range(e.n)))
            hits += other is not None and other[0] >= best[0] - 1e-12
        assert math.isclose(got[chain].p, (hits + 1) / 11)


def random_chains(n, seed):
    """Runs of lengths on both sides of every limit, single residues included."""
    rng = random.Random(seed)
    lengths = [1, 1, 2, 3, 5, 9, 10, 12, 20, 29, 30, 31, 40, 70, 99, 100, 120]
    return [[v for _ in range(rng.randint(1, 9)) for v in [rng.choice([-1, -1, 0, 1, 2])] * rng.choice(lengths)] for _ in range(n)]


def test_post_processing_equals_sql_on_random_runs():
    chains = random_chains(400, 1)
    given = pd.DataFrame([(c, k, v) for c, y in enumerate(chains) for k, v in enumerate(y)], columns=["chain_id", "pos", "label"])
    con = duckdb.connect()
    con.register("given", given)
    got = con.execute("with " + post_processing("given") + " select chain_id, pos, label from post").fetchall()
    assert set(got) == {(c, k, v) for c, y in enumerate(chains) for k, v in enumerate(cleanup.post_processed(y))}
    assert sum(cleanup.post_processed(y) != y for y in chains) > 200


def test_clean_up_of_odd_tables(spark):
    """No rows; one residue; a chain whose only run is an outlier; rows in any order."""
    empty = spark.createDataFrame([], "chain_id int, pos int, label int")
    rows = [(1, 0, 4)] + [(2, k, -1) for k in range(40)] + [(3, k, 0 if k < 35 else 1) for k in reversed(range(40))]
    some = spark.createDataFrame(rows, empty.schema)
    for f in (cleanup.merge_small_clusters, cleanup.post_process):
        assert f(empty, ["chain_id"]).count() == 0
    merged = {(r.chain_id, r.pos): r.label for r in cleanup.merge_small_clusters(some, ["chain_id"]).collect()}
    assert merged[1, 0] == -1 and {merged[2, k] for k in range(40)} == {-1} and {merged[3, k] for k in range(40)} == {0}
    cleaned = {(r.chain_id, r.pos): r.label for r in cleanup.post_process(some, ["chain_id"]).collect()}
    assert cleaned[1, 0] == 4 and {cleaned[2, k] for k in range(40)} == {-1} and {cleaned[3, k] for k in range(40)} == {0}


def test_clean_up_by_runs_equals_the_helpers_on_residues(spark):
    """Chains with gaps and nulls, as residues and as what the runs of the operators give."""
    rng = random.Random(11)
    chains = {c: y for c, y in enumerate(random_chains(120, 3))}
    rows, want_merged, want_cleaned = [], {}, {}
    for c, y in chains.items():
        place, places = 0, []
        for _ in y:
            place += 1 if rng.random() < 0.97 else rng.randint(2, 4)
            places.append(place)
        rows += [(c, p, None if v == -1 and rng.random() < 0.1 else v) for p, v in zip(places, y)]
        want_merged |= {(c, p): v for p, v in zip(places, cleanup.merged_runs(y))}
        want_cleaned |= {(c, p): v for p, v in zip(places, cleanup.post_processed(y, places=places))}
    df = spark.createDataFrame([*rows, (5, None, 1)], "chain_id int, pos int, label int").repartition(5)
    for f, want in ((cleanup.merge_small_clusters, want_merged), (cleanup.post_process, want_cleaned)):
        out = f(df, ["chain_id"])
        assert out.dtypes == df.dtypes
        assert {(r.chain_id, r.pos): r.label for r in out.collect()} == want
