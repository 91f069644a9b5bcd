import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldspark.llm import queries, secrets

from .test_decontam import brute_score
from .test_neardup import brute
from .test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    bad, good = ({i for i, q in labels.items() if q == k} for k in (0, 1))
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.08 * len(bad)


def test_dedup_keeps_the_smallest_of_every_component(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}


def test_leaks_go(spark, stages):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [" ".join((r.text or "").lower().split()) for r in stages[3].collect()]
    assert not any(" ".join(i) in t for i in items for t in left)
    gone = {r.doc_id for r in stages[2].collect()} - {r.doc_id for r in stages[3].collect()}
    texts = {r.doc_id: set(zip(*[(r.text or "").lower().split()[k:] for k in range(3)], strict=False)) for r in stages[2].collect()}
    grams = [set(zip(*[i[k:] for k in range(3)], strict=False)) for i in items]
    assert all(any(len(texts[d] & g) >= 0.3 * len(g) for g in grams) for d in gone)


def test_secrets_are_replaced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, corpus_pipeline.secrets_stage(spark, docs, SF)))
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs, vocabulary, pattern).collect()}
    assert set(before) == set(after) and any(spans.values())
    for i, r in after.items():
        text, hidden = before[i].text or "", [False] * len(before[i].text or "")
        for span in filter(None, spans[i].split(",")):
            a, b = map(int, span.split(":")[1:])
            hidden[a:b] = [True] * (b - a)
        kept = "".join("\0" if h else c for c, h in zip(text, hidden, strict=True))
        clean = re.sub("\\[(assign|access|hex|random)\\]" if any(hidden) else "(?!)", "\0", r.text or "")
        assert re.sub("\0+", "\0", kept) == re.sub("\0+", "\0", clean)
        assert secrets.patterned(r.text or "") == []
        assert r.n_chars == (len(r.text) if any(hidden) else before[i].n_chars)


def test_tokens(spark, stages):
    from foldspark.llm.pieces import Encoder

    lib = Encoder(public_tokenizers.path("piece_bpe_32k.model")).library
    texts = {r.doc_id: r.text or "" for r in stages[4].collect()}
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.ids == lib.encode(texts[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())


def test_run_equals_brute_force(spark, stages):
    """All rows of run(), from those that the classifier keeps: all pairs of shingle sets, every item with every text cell
    by cell, base secrets character by character, and the library's ids."""
    from foldspark.llm.pieces import Encoder

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    firsts = {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}
    split = lambda t: [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(words):
        held = set(words)
        for item in filter(None, items):
            asked = max(0.4, min(8, len(item)) / len(item))
            if sum(w in held for w in item) >= asked * len(item) and brute_score(item, words) >= asked:
                return True
        return False

    encode = secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    lib = Encoder(public_tokenizers.path("piece_bpe_32k.model")).library
    want = {}
    for i, text in rows:
        if i in firsts and not leaked(split(text)):
            base = secrets.patterned(text or "")
            assert [(s.start, s.kind, s.end) for s in sorted(base, key=lambda s: (s.start, s.kind))] == brute_spans(text or "")
            spans = base + secrets.inefficient(text or "", base, encode, 2.0)
            out = secrets.replaced(text, sorted(spans, key=lambda s: (s.start, s.kind))) if spans else text or ""
            want[i] = lib.encode(out)
    assert len(want) > 50 and {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    table = {"op1_hnsw_neighbours": None, "op3_warc_revisits": "pages", "op7_url_rules": "pages", "op6_benchmark_decontamination": None, "op9_license_windows": None}.get(name, "documents")
    n = queries.QUERIES[name](spark, SF).count()
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0


def test_decontamination_removes_rows_not_ids(spark, tmp_path):
    item = "seven green boats crossed the quiet harbour before the storm had reached the old town"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"look {item} there"), (None, "no passage of any kind in here"), (5, f"again {item}"), (5, "another text of the same number")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(r.text for r in left.collect()) == [rows[3][1], rows[1][1]]


LONG = "plain words of a very long text " * 30_000
TEXTS = ["the cat sat on the mat and slept all day", "a quite different text about boats and the sea", None, "", " \n", LONG]


def odd(spark, empty=False):
    """Rows without id, of repeated ids, null, blank and very long texts, and columns named like those made inside."""
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (None, TEXTS[0]), (2, TEXTS[0]), (2, TEXTS[0]), (None, None), (None, None), (3, ""), (4, " \n"), (None, LONG), (5, LONG)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint")
    docs = docs.withColumns({c: F.lit(c) for c in ("id", "node", "spans", "ids", "score", "item_id", "n")})
    return docs.limit(0) if empty else docs.repartition(3)


@pytest.mark.parametrize("stage, rows", [(0, None), (1, {0, 1, 5, 6, 7, 8, 10}), (2, set(range(11))), (3, set(range(11)))])
def test_stages_take_odd_rows(spark, stage, rows):
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, odd(spark), SF)
    found = out.collect()
    assert out.columns == odd(spark).columns
    assert rows is None or {r.row for r in found} == rows
    before = {r.row: r for r in odd(spark).collect()}
    assert all(r == before[r.row] for r in found)
    assert f(spark, odd(spark, empty=True), SF).collect() == []


def test_tokens_of_odd_rows(spark):
    out = corpus_pipeline.tokens_stage(spark, odd(spark), SF).collect()
    assert len(out) == 11 and sum(r.n_tokens == 0 for r in out) == 3
    assert corpus_pipeline.tokens_stage(spark, odd(spark, empty=True), SF).collect() == []


def test_intermediate_tables_are_deleted(spark, monkeypatch, tmp_path):
    from foldspark.llm import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, SF).count()
    left = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert rows > 0 and left == ["stage"]
