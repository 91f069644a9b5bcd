import random

import pytest

from foldspark.llm import licenses

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "so", "la") for b in ("x", "n", "r", "st", "ld", "m", "q")]


def grams(text, k=5):
    w = text.lower().split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(text, template):
    """Best share of the template's shingles within any stretch of its length on either side of a shingle of the text."""
    own, all_ = set(grams(template)), grams(text)
    n = len(grams(template))
    return max((len(own & set(all_[max(0, i - n) : i + 2 * n])) / len(own) for i in range(len(all_)) if all_[i] in own), default=0.0)


def test_planted_templates(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(160):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(0, 300))]
        if i % 2:
            name = list(licenses.TEMPLATES)[(i // 2) % len(licenses.TEMPLATES)]
            own = licenses.TEMPLATES[name].split()
            if i % 4 == 3 and len(own) > 25:
                own[len(own) // 2] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own if i % 3 else [w.upper() for w in own]
        rows.append((i, " ".join(words)))
    for i, text in rows:
        for name, template in licenses.TEMPLATES.items():
            if (share := brute(text, template)) >= 0.8:
                want[i, name] = share
    docs = spark.createDataFrame([(t, i, "l") for i, t in [*rows, (900, None), (901, "")]], "text string, doc_id bigint, license_id string").repartition(3)
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan_licenses(docs).collect()}
    assert len(want) >= 80 and got == pytest.approx(want)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    line = "x y " + licenses.TEMPLATES["mit-line"]
    docs = spark.createDataFrame([(1, line), (1, line), (None, line + " z")], "doc_id bigint, text string")
    rows = licenses.scan_licenses(docs).collect()
    assert [(r.license_id, r.start_word, r.end_word) for r in rows] == [("mit-line", 2, 7)] * 3 and sum(r.doc_id is None for r in rows) == 1


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.Templates({"x": "four words are few"}, 5)


def test_recall_of_edited_copies_in_long_texts(spark):
    """Every built-in template, intact and with edited words, at odd places of long texts."""
    rng = random.Random(11)
    filler = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(3000)]
    rows, want = [], set()
    for t, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        for edits in range(4):
            own = list(words)
            if edits and len(words) < 40:
                continue
            for at in rng.sample(range(5, len(words) - 5), edits) if edits else []:
                own[at] = "edited"
            at, i = rng.randrange(3000), 10 * t + edits
            rows.append((i, " ".join(filler[:at] + own + filler[at:])))
            shingles = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
            left = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            if len(shingles & left) >= 0.8 * len(shingles):
                want.add((i, name))
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want <= got and len(want) >= len(licenses.TEMPLATES)


def test_ties_between_places_go_to_the_earliest(spark):
    text = licenses.TEMPLATES["bsd"]
    n = len(text.split())
    between = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, f"a b {text} {between} {text}", "x")], "doc_id bigint, text string, containment string")
    (row,) = licenses.scan_licenses(docs).collect()
    assert (row.license_id, row.containment, row.start_word, row.end_word) == ("bsd", 1.0, 2, 2 + n)


def test_texts_beyond_one_slice(spark):
    rng = random.Random(6)
    filler = [f"v{rng.randrange(10**6)}" for _ in range(90_000)]
    text = licenses.TEMPLATES["apache-2.0"]
    whole = " ".join(filler[:80_000] + text.split() + filler[80_000:])
    assert len(whole) > 2 * (1 << 18)
    docs = spark.createDataFrame([(1, "short " + text), (2, whole), (3, "after " + text)], "doc_id bigint, text string").coalesce(1)
    got = {(r.doc_id, r.license_id): r.start_word for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "apache-2.0"): 1, (2, "apache-2.0"): 80_000, (3, "apache-2.0"): 1}
