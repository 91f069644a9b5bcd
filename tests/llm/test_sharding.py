import random
import zlib
from collections import Counter

from foldspark.llm import sharding


def sequential(counts, nodes, shards):
    """Rows one by one, in the order of the plan's rounds: a refused row tries the next shards clockwise."""
    total = sum(counts.values())
    each, over = divmod(total, shards)
    room = {s: each + (k < over) for k, s in enumerate(dict.fromkeys(s for _, s in nodes))}
    place = {}
    waiting = []
    for cell in sorted(counts):
        start = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        waiting += [(cell, r, start) for r in range(counts[cell])]
    while waiting:
        refused = []
        starts = {}
        for cell, r, at in waiting:
            if (cell, at) not in starts:
                k = at
                while not room[nodes[k][1]]:
                    k = (k + 1) % len(nodes)
                starts[cell, at] = k
            k = starts[cell, at]
            if room[nodes[k][1]]:
                room[nodes[k][1]] -= 1
                place[cell, r] = nodes[k][1]
            else:
                refused.append((cell, r, k))
        waiting = refused
    return place


def test_plan_equals_one_by_one():
    rng = random.Random(0)
    for _ in range(20):
        nodes = sorted((rng.randrange(100), rng.randrange(5)) for _ in range(20)) + [(99, s) for s in range(5)]
        counts = {rng.randrange(100): rng.randrange(1, 9) for _ in range(30)}
        got = {}
        slots = Counter()
        for cell, lo, hi, shard, base in sharding.plan(counts, nodes, 5):
            assert base == slots[shard]
            slots[shard] += hi - lo
            got |= {(cell, r): shard for r in range(lo, hi)}
        assert got == sequential(counts, nodes, 5) and max(slots.values()) - min(slots[s] for s in range(5)) <= 1


def test_documents(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text é {i}") for i in range(997)] + [(None, None), (None, "x"), (None, ""), (5, "y"), (5, "y")]
    docs = spark.createDataFrame([(t, i, "a") for i, t in rows], "text string, doc_id bigint, shard string").repartition(3)
    got = sharding.assign_shards(docs, 24).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.assign_shards(docs.repartition(5), 24).collect() if r.doc_id != 5}
    assert again == {(r.doc_id, r.text_crc32): r.shard for r in got if r.doc_id != 5}
    assert sharding.assign_shards(docs.limit(0), 24).collect() == []


def test_hot_cells_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 50)
    rows = [(None, "same")] * 400 + [(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sharding.assign_shards(docs, 24).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1200 and all(sorted(s) == list(range(50)) for s in by.values()) and len(by) == 24


def test_hot_and_cold_cells_are_numbered_alike(spark, monkeypatch):
    rows = [(None, "same")] * 400 + [(7, f"text {i}") for i in range(900)] + [(i, "x") for i in range(600)] + [(None, f"t{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    for hot, parts in ((1_000_000, 3), (50, 3), (50, 7), (1, 5)):
        monkeypatch.setattr(sharding, "HOT", hot)
        found.append(Counter(tuple(r) for r in sharding.assign_shards(docs.repartition(parts), 24).collect()))
    assert found[0].total() == 2300 and all(f == found[0] for f in found)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "é" * 1_000_000)], "doc_id bigint, text string")
    assert [(r.size, r.slot) for r in sharding.assign_shards(docs, 24).collect()] == [(2_000_008, 0)]


def test_movement_is_limited(spark):
    docs = spark.createDataFrame([(i, "") for i in range(6000)], "doc_id bigint, text string")
    one, two = ({r.doc_id: r.shard for r in sharding.assign_shards(docs, n, slack=0.25).collect()} for n in (24, 25))
    assert sum(one[i] != two[i] for i in one) < 0.1 * len(one)
    assert max(Counter(one.values()).values()) <= 6000 * 1.25 / 24 + 1
    one, two = ({r.doc_id: r.shard for r in sharding.assign_shards(docs, n).collect()} for n in (24, 25))
    assert sum(one[i] != two[i] for i in one) < 0.1 * len(one)


def test_native():
    import inspect

    text = inspect.getsource(sharding)
    assert not any(w in text for w in ("pandas", "udf", "mapIn", "rdd", "pyarrow"))
