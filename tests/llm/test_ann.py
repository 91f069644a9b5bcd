import numpy as np
import pytest

from foldspark.llm import ann


def exact(vectors, queries, k):
    ids = sorted(vectors)
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(np.array(vectors[q]), np.array(vectors[i]))), i) for i in ids if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("spread", [0.0, 0.7])
def test_recall(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.lognormal(0, spread, (1500, 1))
    vectors = {i: x[i].astype(np.float32).astype(float).tolist() for i in range(1500)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id bigint, embedding array<float>")
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=400))
    want = exact(vectors, range(0, 1500, 20), 20)
    assert recall(got, want) >= 0.9
    for q in want:
        assert all(s == pytest.approx(np.dot(vectors[q], vectors[i]), abs=1e-12) for i, s in got[q])


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 500)]
    bad = [(600, None), (620, [0.0, 0.0, 0.0]), (640, [1.0, None, 2.0]), (660, [float("nan"), 1.0, 1.0]), (680, [float("inf"), 1.0, 1.0]), (700, [1.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(v, i, 0) for i, v in rows + bad], "embedding array<double>, vec_id bigint, rank int")
    got = found(ann.nearest(df, df.where("vec_id % 20 = 0"), k=5))
    want = exact(dict(rows), range(0, 500, 20), 5)
    assert set(got) == set(want) and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(3)], "vec_id bigint, embedding array<double>")
    assert found(ann.nearest(df, df, k=20)) == exact({i: [i + 1.0, 1.0] for i in range(3)}, range(3), 20)
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_plan():
    plan = ann.shard_plan({0: 5000, 1: 100, 2: 3}, 1000)
    assert {b for b, _, _ in plan} == {0, 1, 2} and max(f + p for _, f, p in plan) <= 7


@pytest.mark.parametrize("dims", [32, 64, 128, 256, 768])
def test_recall_of_a_full_shard_without_clusters(dims):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(ann.SHARD_ROWS, dims))
    members, tables = ann.build(x, ann.mix(np.arange(len(x), dtype=np.uint64)).view(np.int64))
    queries = x[:: 40 if dims <= 64 else 128]
    held, _ = ann.search(x, members, tables, queries, ann.breadth_for(dims))
    best = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(held[:, :20].tolist(), best.tolist(), strict=True)]) >= 0.95


def test_many_ties_over_several_shards(spark):
    """Vectors of few values: very many equal scores, whose order is that of the ids."""
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (600, 6))
    x = x[(x != 0).any(axis=1)]
    vectors = {i: v.astype(float).tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    got = found(ann.nearest(df, df.where("vec_id % 7 = 0"), k=10, shard_rows=100))
    want = exact(vectors, [i for i in vectors if i % 7 == 0], 10)
    assert all([s for _, s in got[q]] == [s for _, s in want[q]] for q in want)
    assert all([(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q]) for q in got)
    assert recall(got, want) >= 0.95


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 8 * 10)
    monkeypatch.setattr(ann, "TOGETHER", 3)
    x = np.random.default_rng(4).normal(size=(300, 8))
    vectors = {i: x[i].tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    got = found(ann.nearest(df, df.where("vec_id % 5 = 0"), k=4, shard_rows=100))
    assert recall(got, exact(vectors, range(0, 300, 5), 4)) >= 0.98


def test_beams_follow_the_data():
    """Vectors of one length need less than those of several, and less where only some of the nearest lie in a shard."""
    gaussian = np.random.default_rng(6).normal(size=(8192 + 320, 64))
    beams = []
    for x in (gaussian / np.sqrt((gaussian * gaussian).sum(axis=1))[:, None], gaussian):
        x, probes, asked = x[:8192], x[8192:8256], x[8256:]
        members, tables = ann.build(x, ann.mix(np.arange(len(x), dtype=np.uint64)).view(np.int64))
        beams.append([ann.measured_breadth(x, members, tables, probes, k) for k in (21, ann.share(21, 50))])
        best = np.argsort(-(asked @ x.T), axis=1)[:, :20]
        for beam, k in zip(beams[-1], (20, ann.share(20, 50)), strict=True):
            held, _ = ann.search(x, members, tables, asked, beam)
            assert np.mean([len(set(a) & set(b)) / k for a, b in zip(held.tolist(), best[:, :k].tolist(), strict=True)]) >= 0.98
    assert beams[0][1] < beams[0][0] < beams[1][0] and beams[0][1] < ann.breadth_for(64) < beams[1][0]


@pytest.mark.parametrize("parts", [1, 2, 7, 50, 1000])
def test_share_of_a_shard(parts):
    """More of the nearest than are measured lie in one shard very seldom."""
    most = np.random.default_rng(8).multinomial(21, [1 / parts] * parts, size=2000)
    assert (most > ann.share(21, parts)).mean() < 1e-3


def test_beams_do_not_follow_the_unit():
    x = np.random.default_rng(9).normal(size=(2000, 16))
    beams = set()
    for unit in (1.0, 1e-30, 1e30):
        members, tables = ann.build(x * unit, ann.mix(np.arange(len(x), dtype=np.uint64)).view(np.int64))
        beams.add(ann.measured_breadth(x * unit, members, tables, x[::40] * unit, 21))
    assert len(beams) == 1 and max(beams) < 1000


def test_ties_that_fill_more_than_a_beam(spark):
    """Two thousand equal scores in one shard: the smallest ids of them are found, however the rows arrive."""
    rng = np.random.default_rng(10)
    y = rng.normal(size=(2000, 63))
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    rows = [(i, [1.0, *y[i].tolist()]) for i in rng.permutation(2000).tolist()] + [(9000, [1.0, *[0.0] * 63])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(ann.nearest(df, df.where("vec_id = 9000"), k=20))[9000]
    assert [s for _, s in got] == [1.0] * 20 and [i for i, _ in got] == sorted(i for i, _ in got)
    assert len({i for i, _ in got} & set(range(20))) >= 18
