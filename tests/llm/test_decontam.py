import random

import numpy as np
import pytest

from foldspark.llm import decontam

WORDS = [a + b + c for a in ("ba", "ko", "mi", "tu", "re", "so") for b in ("x", "n", "r", "st", "ld") for c in ("a", "e", "ion")]


def brute_score(item, text):
    """Smith-Waterman over word lists, cell by cell, as a share of an exact copy's score."""
    best = 0
    above = [0] * (len(text) + 1)
    for a in item:
        now = [0]
        for j, b in enumerate(text, 1):
            now.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, now[-1] - 1))
        best, above = max(best, *now), now
    return best / (2 * len(item))


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(80)]
    windows = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64) for _ in range(80)]
    scores, ends = decontam.align(items, windows)
    assert [s / (2 * len(i)) for s, i in zip(scores, items, strict=True)] == [brute_score(i.tolist(), w.tolist()) for i, w in zip(items, windows, strict=True)]


def test_long_items_and_texts(spark, monkeypatch):
    rng = random.Random(5)
    item = [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(6000)]
    copy = [w for k, w in enumerate(item) if k % 50] + ["end"]
    other = [rng.choice(WORDS) for _ in range(150_000)]
    rows = [(1, other + copy), (2, other), (3, item[:1500]), (4, item)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {1, 4} and got[4].score == 1 and got[1].score == pytest.approx((2 * 5880 - 119) / 12000)
    assert (got[4].start_word, got[4].end_word) == (0, 6000) and got[1].end_word == 150_000 + 5880


@pytest.mark.parametrize("parts, between, score", [(3, 2100, (2 * 5850 - 4200) / 11700), (2, 2500, (2 * 5850 - 2500) / 11700), (5, 1200, (2 * 5850 - 4800) / 11700)])
def test_long_items_in_parts(spark, parts, between, score):
    rng = random.Random(6)
    item = [f"w{k}" for k in range(5850)]
    other = lambda n: [rng.choice(WORDS) for _ in range(n)]
    text = other(3000)
    for k in range(parts):
        text += (other(between) if k else []) + item[k * 5850 // parts : (k + 1) * 5850 // parts]
    docs = spark.createDataFrame([(1, " ".join(text + other(3000)))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    (row,) = decontam.contaminated(docs, bench).collect()
    assert row.score == pytest.approx(score) and row.end_word == len(text)


def test_found_pairs_are_all_pairs(spark):
    """Every item with every text that holds enough of its words, cell by cell."""
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    texts = {r.doc_id: [w for w in split(r.text) if w] for r in docs.collect()}
    want = {}
    for r in bench.collect():
        item = [w for w in split(r.text) if w]
        asked = max(0.4, min(8, len(item)) / len(item))
        for d, words in texts.items():
            held = set(words)
            if sum(w in held for w in item) >= asked * len(item) and (score := brute_score(item, words)) >= asked:
                want[d, r.item_id] = score
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


def test_common_short_items_can_be_asked_for(spark):
    docs = spark.createDataFrame([(i, f"text {i} until the end of it") for i in range(20)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(3, "the end")], "item_id bigint, text string")
    assert decontam.contaminated(docs, bench).count() == 0
    assert decontam.contaminated(docs, bench, rare=None).count() == 20


def test_ties_between_windows_go_to_the_earliest(spark):
    item = "one two three four five six seven eight nine"
    text = f"{item} {'x ' * 200}{item}"
    docs = spark.createDataFrame([(1, text, 0.5)], "doc_id bigint, text string, score double")
    (row,) = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert (row.score, row.start_word, row.end_word) == (1.0, 0, 9)


def test_few_cells_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 40, 400)
    items = decontam.Items([(i, " ".join(f"w{x}" for x in words[9 * i : 9 * i + 5 + i])) for i in range(20)], 3)
    column = decontam.pa.array([" ".join(f"w{x}" for x in words)])
    whole = list(decontam.matches(items, column, 0.4))
    monkeypatch.setattr(decontam, "CELLS", 50)
    assert list(decontam.matches(items, column, 0.4)) == whole and len(whole) == 20


def test_rows_are_dropped_by_their_own_text(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, item, 0), (1, "clean text", 1), (None, f"so {item} end", 2), (None, None, 3), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, "not here at all")], "item_id bigint, text string")
    for chars in (4_000_000, 20):
        monkey = pytest.MonkeyPatch()
        monkey.setattr(decontam.parts, "__defaults__", (chars,))
        clean = decontam.without_contaminated(docs, bench)
        assert clean.columns == docs.columns and sorted(r.item_id for r in clean.collect()) == [1, 3, 4]
        monkey.undo()
    assert decontam.without_contaminated(docs.limit(0), bench).collect() == []
    assert decontam.without_contaminated(docs, bench.limit(0)).count() == 5


def edited(rng, words, share):
    out = [rng.choice(WORDS) if rng.random() < share else w for w in words]
    out.insert(len(out) // 2, "extra")
    return out[:3] + out[4:]


def test_planted_passages(spark):
    rng = random.Random(3)
    items = {i: [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))] for i in range(25)}
    clean = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, want = [], set()
    for i in range(120):
        words, item = clean(rng.randrange(5, 200)), i % 25
        if i % 3 == 1:
            words += items[item] if i % 2 else edited(rng, items[item], 0.12)
            want.add((i, item))
        rows.append((i, " ".join(words + clean(20) * (i % 2))))
    rows += [(200 + i, " ".join(items[7])) for i in range(40)] + [(300, None), (301, "")]  # a passage in very many texts
    want |= {(200 + i, 7) for i in range(40)}
    docs = spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id bigint, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items.items()] + [(90, None), (91, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == want
    for (d, i), r in got.items():
        text = dict(rows)[d].lower().split()
        assert r.score == pytest.approx(brute_score(items[i], text))
        assert 0 <= r.start_word < r.end_word <= len(text)


def test_parts_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "zero one two three four five"), (2, "nothing here at all"), (1, "zero one two three four five")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four"), (2, "three four"), (3, "absent words only here")], "item_id bigint, text string")
    whole = sorted(decontam.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam.parts, "__defaults__", (10,))
    assert sorted(decontam.contaminated(docs, bench).collect()) == whole
    assert [(r.doc_id, r.item_id, r.score) for r in whole] == [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_short_items_need_more_than_a_common_phrase(spark):
    items = {1: "what is the capital of france", 2: "how many of the", 3: "the end", 4: "name one of the largest rivers that flow through central asia"}
    clean = ["nobody knows what is the matter with him", "what is the capital of peru", "tell me how many of them came", "one of the largest dogs barked", "what is the use of all this"] * 4
    clean += [f"text {i} goes on until the end of it" for i in range(20)]  # an item of two words is common here
    copies = [("so What is the capital of France he asked", 1), ("name one of the largest rivers that run through central asia please", 4), ("just say how many of the", 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *(t for t, _ in copies)])], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(len(clean) + i, item) for i, (_, item) in enumerate(copies)}
