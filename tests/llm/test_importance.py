import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from foldspark.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, n):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, seed="2024", percent=10, least=20):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    held = [(i, len(runs(t, n)[0]), [bucket(r) for r in runs(t, n)[1]]) for i, t in docs]
    s = Counter(b for _, _, x in held for b in x)
    t = Counter(bucket(r) for text in target for r in runs(text, n)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, x in held:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    out = [(r[0], *r[2:], k) for k, r in enumerate(drawn, 1)]
    left = Counter(rows) - Counter(drawn)
    return sorted(out + [(r[0], *r[2:], None) for r in left.elements()], key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "É", "x1", "2", "日本", "o'neil", "a-b", "\x00", "\n", "  ", "."]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_the_plain_definition(spark, n):
    rows = list(enumerate(["", None, "one", *texts(300)]))
    target = texts(20, 9)[:10] + [None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resample(docs, goal, n=n, buckets=500)) == plain(rows, target, n, 500)


def test_repeated_rows_and_missing_ids(spark):
    one = " ".join(["alpha beta"] * 15)
    rows = [(5, one)] * 200 + [(None, one)] * 100 + list(enumerate(texts(100)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    goal = spark.createDataFrame([(one,)], "text string")
    found = got(importance.resample(docs, goal, percent=60))
    assert found == plain(rows, [one], percent=60)
    ranks = [r[4] for r in found if r[4]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id bigint, text string")
    assert got(importance.resample(none, some)) == []
    assert got(importance.resample(none, none)) == []
    assert got(importance.resample(some, none, percent=100)) == plain([(1, "a b c " * 10), (2, None)], [], percent=100)


def test_clashing_columns_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, 1, 1, 1), (2, "a " * 30, 2, 2, 2)], "doc_id bigint, text string, score int, part int, row int")
    goal = spark.createDataFrame([("w1 w2", 1)], "text string, doc_id int")
    assert got(importance.resample(docs, goal, percent=50)) == plain([(1, long), (2, "a " * 30)], ["w1 w2"], percent=50)
