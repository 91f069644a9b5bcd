import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foldspark.llm import alignment, bytepairs

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "  two  spaces ", "▁x y", "<|endoftext|> and <s> </s>", "\x00 nul", "日本語のテキスト", "😀😀 x 😀", "é ﬁ １", "don't 'stop'", "\n\n\tx", "a" * 500, "😀" * 300, "ab " * 400]


def plain(rows):
    """Rows of the contract by overlaps of byte ranges, one document at a time."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    byte = bytepairs.byte_names()
    found, held = [], defaultdict(int)
    for doc_id, text in rows:
        text, a, b, groups, links = text or "", [], [], [], Counter()
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            own_a = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a]
            own_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(own_a) != (" " + text).encode() or b"".join(own_b) != (" " + text).encode():
                a, b = [], []
        if a:
            ends_a, ends_b = np.cumsum(list(map(len, own_a))).tolist(), np.cumsum(list(map(len, own_b))).tolist()
            lo_a = lo_b = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                hi_a, hi_b = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append((a[lo_a:hi_a], b[lo_b:hi_b]))
                links.update((x, y) for x in a[lo_a:hi_a] for y in b[lo_b:hi_b])
                lo_a, lo_b = hi_a, hi_b
            for pair in links:
                held[pair] += 1
        found.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), links.total(), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=str)


def got(rows):
    return sorted((tuple(r[c] for c in alignment.COLUMNS) for r in rows), key=str)


def random_texts(n, seed=0, letters="ab é \n\t%&01日<>x.,E😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_plain_definition(spark):
    rows = list(enumerate(ODD + random_texts(400) + ["the same words again"] * 30)) + [(None, "no id"), (3, "the same id"), (3, "the same id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(alignment.aligned_tokens(docs, BYTES, PIECES).collect()) == plain(rows)


def test_over_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(alignment.aligned_tokens(docs, BYTES, PIECES).collect()) == plain(rows)


@pytest.mark.parametrize("direct", [0, 3, 10**9])
def test_groups_over_distinct_ids_are_the_same(monkeypatch, direct):
    rng = np.random.default_rng(1)
    text = np.sort(rng.integers(0, 5, 40))
    of_a, of_b = (np.sort(np.concatenate([np.arange(40), rng.integers(0, 40, 300)])) for _ in range(2))
    a, b = rng.integers(0, 6, len(of_a)), rng.integers(0, 6, len(of_b))
    monkeypatch.setattr(alignment, "DIRECT", direct)
    keys, times = alignment.products(a, of_a, b, of_b, text, 10)
    want = Counter(int(text[g]) * 100 + int(x) * 10 + int(y) for g in range(40) for x in a[of_a == g] for y in b[of_b == g])
    assert dict(zip(keys.tolist(), times.tolist())) == want


def test_blocks_of_other_sizes_give_the_same(spark, monkeypatch):
    rows = list(enumerate(random_texts(60, 5)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert got(alignment.aligned_tokens(docs, BYTES, PIECES).collect()) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.aligned_tokens(docs, BYTES, PIECES).collect() == []
    docs = spark.createDataFrame([(1, "x y", 9, 9)], "doc_id bigint, text string, pair int, block int")
    assert got(alignment.aligned_tokens(docs, BYTES, PIECES).collect()) == plain([(1, "x y")])
