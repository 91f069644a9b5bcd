import random
import struct
import zlib

import public_tokenizers as P
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from foldspark.llm import bytepairs, tokenfiles
from foldspark.llm.scratch import new_path

FILE = P.path("byte_bpe_50k.json")
ODD = ["", None, " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't  stop\n\n", "日本語 é　x", "😀" * 50, "word " * 5000]


def random_texts(n, seed=0, letters=("<|endoftext|>", " ", "  ", "a", "B", "'s", "'", "\n", "é", "日", "1", ".", "▁", "́", "Ω", " ")):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def plain(rows):
    lib, start, out = Tokenizer.from_file(FILE), 0, []
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def read(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("special", [False, True])
def test_segments_encode_as_whole_texts(special):
    lib, enc = Tokenizer.from_file(FILE), bytepairs.ByteEncoder(FILE)
    lib.encode_special_tokens = not special
    texts = [x or "" for x in ODD] + random_texts(5000)
    for _ in range(2):
        ids, bounds = (enc.encode_with_special if special else enc.encode)(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_written_in_order_and_read_back(spark):
    rows = list(enumerate(ODD + random_texts(300)))
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id bigint, text string").repartition(6)
    assert read(tokenfiles.tokens_written_and_read(docs, FILE)) == plain(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(None, "x y")] * 40 + [(7, "same")] * 60 + [(8, "last")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path, FILE, ranges=5)
    assert read(tokenfiles.with_crc(tokenfiles.read_tokens(spark, path))) == plain(rows)
    # Equal ids, and rows without id, are dealt to several ranges.
    assert spark.read.orc(path).where("doc_id = 7").select("range").distinct().count() > 1


def test_empty_table_and_clashing_columns(spark):
    assert read(tokenfiles.tokens_written_and_read(spark.createDataFrame([], "doc_id bigint, text string"), FILE)) == []
    docs = spark.createDataFrame([(1, "x", 5, 5)], "doc_id bigint, text string, place int, range int")
    assert read(tokenfiles.tokens_written_and_read(docs, FILE)) == plain([(1, "x")])


def scanned(df):
    """Rows that the scan below ``df`` gave out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    leaves = node.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_statistics_and_bloom_filters_exclude_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "'some text' as text")
    tokenfiles.write_tokens(docs, path, FILE, ranges=2)
    assert [r.doc_id for r in tokenfiles.look_up(spark, path, [5000]).collect()] == [5000]
    assert 0 < scanned(tokenfiles.look_up(spark, path, [5000])) <= tokenfiles.STRIDE
    # 5001 lies inside a row group's range; only the Bloom filter tells that it isn't there.
    assert scanned(tokenfiles.look_up(spark, path, [5001])) == 0


def test_several_stripes_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 200_000)
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(100))) for i in range(2000)]
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path, FILE, ranges=1)
    files = list((tmp_path / "tokens").glob("*.orc"))
    assert len(files) == 1 and pyarrow.orc.ORCFile(files[0]).nstripes > 1
    # Splits below a stripe's size: several tasks read the file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = tokenfiles.read_tokens(spark, path)
        assert spark.read.orc(path).rdd.getNumPartitions() > 1
        assert read(tokenfiles.with_crc(found)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
