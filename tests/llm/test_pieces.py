import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from foldspark.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a   b  ", "\n\n x\r\n\t", "▁x ▁▁ y", "<s> </s> <unk> <0x0A>", "\x00a\x1fb", "日本語 é ﬁ １", "a" * 3000, " " * 60, "😀😀 x😀", "%%% ### !!! ---", "x" * 33 + " y"]


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(MODEL)


def encoded(enc, texts):
    ids, bounds = enc.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def random_texts(n, seed=0, letters="ab é▁ \n\t%&01日<>x.,E"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_equal_the_library(enc):
    texts = ODD + random_texts(1500)
    ids, bounds = enc.encode(texts)
    want = enc.library.encode(texts)
    assert encoded(enc, texts) == want
    assert [bytes(x).decode() for x in enc.decimals(ids, bounds)] == [",".join(map(str, x)) for x in want]


def test_matrix_and_heap_agree(enc):
    rng = random.Random(1)
    segments = ["▁" + "".join(rng.choice("aeionrstlhdcu'é") for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    ids, counts = enc.merged(points, np.array([len(s) for s in segments]))
    assert [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])] == [enc.merge(s) for s in segments]


def test_a_full_table_is_emptied(enc, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    texts = [f"word{i % 7} other{i}" for i in range(40)]
    assert [x for t in texts for x in encoded(enc, [t])] == enc.library.encode(texts)


def test_long_texts_go_in_blocks(enc, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    texts = ["", *random_texts(60, 2), " ".join(random_texts(400, 3)), "b" * 500, ""]
    assert encoded(enc, texts) == enc.library.encode(texts)


def test_a_million_characters(enc):
    text = " ".join(random_texts(50_000, 4, "abcdefghij é,."))
    assert encoded(enc, [text]) == [enc.library.encode(text)]


def test_segments_that_share_a_hash(enc, monkeypatch):
    monkeypatch.setattr(pieces.W, "ranges_hash", lambda values, starts, sizes: sizes.astype(np.uint64) << np.uint64(60))
    enc._forget()
    texts = random_texts(300, 5)
    assert encoded(enc, texts) == enc.library.encode(texts)
    enc._forget()


def test_a_difference_is_an_error(enc):
    points = np.frombuffer("▁some▁text".encode("utf-32-le"), np.uint32)
    ids, counts = enc.merged(points, np.array([5, 5]))
    enc.check(points, np.array([5, 5]), ids, counts)
    with pytest.raises(ValueError):
        enc.check(points, np.array([5, 5]), ids + 1, counts)


def test_documents(spark, enc):
    rows = [(i, t) for i, t in enumerate([*ODD, None, ODD[2]])] + [(None, "x")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id bigint, ids int")
    got = pieces.encode_documents(docs, MODEL, keep=True).collect()
    assert len(got) == len(rows)
    want = {i: enc.library.encode(t or "") for i, t in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = want[r.doc_id]
        decoded = enc.library.decode(ids) if ids else ""
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(decoded)
        assert r.doc_id is None or r.decoded == dict(rows)[r.doc_id] or r.doc_id in (0, 13) or "▁" in dict(rows)[r.doc_id]
    assert pieces.encode_documents(docs.limit(0), MODEL).collect() == []
