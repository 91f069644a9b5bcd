import random
import re

import pytest
from pyspark.sql import functions as F

from foldspark.llm import neardup
from foldspark.llm.neardup import deduplicate, near_duplicates, sketch_limit, sketch_similarity

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "so", "la", "ne") for b in ("x", "n", "r", "st", "ld", "m")]


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num, den):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (3, 12, 40, 90, 200):
        for _ in range(6):
            base = [rng.choice(WORDS) for _ in range(size)]
            for _ in range(rng.choice([1, 2, 6])):
                own = list(base)
                for _ in range(rng.choice([0, 0, 1, 2, size // 12])):
                    own[rng.randrange(size)] = rng.choice(WORDS)
                rows.append((i, " ".join(own)))
                i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rows = corpus() + [(1000, ""), (1001, None), (1002, " \n\t "), (1003, "One"), (1004, "one "), (1005, "ONE two"), (1006, "É x"), (1007, "é x")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id bigint, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, words=k).collect()}
    assert got == brute(rows, k, 80, 100)


def test_chain_of_copies(spark):
    # Each text resembles the next, the ends don't resemble each other.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80, 100).items()} and set(got.values()) == {0}


@pytest.mark.parametrize("large, block", [(64, 200_000), (3, 700)])
def test_group_torn_around_its_smallest_node(spark, monkeypatch, large, block):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(100), rng.choice([2, 4, 6, 9])):
            own[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80, 100).items()}


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "z y x"), (3, "A B C")], "doc_id bigint, text string")
    rows = near_duplicates(docs, words=2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert near_duplicates(docs.limit(0), words=2).collect() == []
    kept = deduplicate(docs.withColumn("id", F.lit(1)), words=2)
    assert kept.columns == ["doc_id", "text", "id"] and sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "z y x"), (3, "A B C")]
    assert deduplicate(docs.limit(0), words=2).collect() == []


def test_deduplication_tells_rows_apart(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "p q r s"), (2, None), (3, "p q r s"), (None, "p q r s"), (None, ""), (None, "u v w x"), (4, " ")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id bigint, _n string").repartition(3)
    kept = deduplicate(docs, words=2).collect()
    want = [(1, "a b c d"), (2, "p q r s"), (2, None), (None, ""), (None, "u v w x"), (4, " ")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, want))


def test_rows_that_share_an_id_go_by_their_own_texts(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "p q r s"), (3, "p q r s")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_very_long_texts(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(10**5)) for _ in range(120_000)]
    near = [w if k % 100 else "x" for k, w in enumerate(base)]
    rows = [(7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base[::-1])), (10, "y" * 1_000_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {7: 7, 8: 7, 9: 9, 10: 10}


def test_sketch_distance():
    assert sketch_similarity(0, 300) == 1
    assert sketch_similarity(sketch_limit(0.8, 300), 300) < 0.72
    assert sketch_limit(0.9, 300) < sketch_limit(0.8, 300)
