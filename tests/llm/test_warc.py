import gzip
import hashlib

from pyspark.sql import functions as F

from foldspark.llm import warc

BIG = "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 30
ROWS = [(7, "http://a/ b\n", BIG), (3, None, BIG), (9, "u", BIG), (9, "u", BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", "y" * 100), (8, "u", "y" * 99), (11, "u", "y" * 99), (None, "u", BIG), (None, "u", "z" * 200)]


def pages(spark):
    return spark.createDataFrame([(h, i, u, "r") for i, u, h in ROWS], "html string, page_id bigint, url string, record_type string").repartition(3)


def want():
    out = []
    for i, _, h in ROWS:
        h = h or ""
        data = h.encode()
        same = [j for j, _, g in ROWS if (g or "") == h and j is not None]
        again = len(data) >= 100 and bool(same) and i != min(same)
        out.append((i or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else -1))
    return sorted(out)


def got(df):
    return sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in df.collect())


def test_round_trip(spark):
    assert got(warc.archive_pages(pages(spark))) == want()


def test_archives_are_deduplicated(spark, tmp_path):
    path = str(tmp_path / "one")
    rows = warc.with_headers(pages(spark).where("page_id is not null")).select("*", F.lit("response").alias("record_type"))
    rows = rows.withColumns({"refers_to": F.lit(None).cast("bigint"), "refers_url": F.lit(None).cast("string")})
    warc.write_archives(rows, path, file_records=2)
    files = list((tmp_path / "one").rglob("*.gz"))
    records = [r for f in files for r in warc.parse_archive(f.read_bytes())]
    assert len(files) > 3 and {r["warc-type"] for r in records} == {"response"} and len(records) == 11
    again = warc.deduplicate_archives(spark, path, str(tmp_path / "two"))
    assert got(again) == [w for w in want() if w[0] != -1]
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "two").rglob("*.gz"))
    assert text.count(BIG.encode()) == 1 and text.count(b"X-Refers-To-Page-ID: 3\r\n") == 3
    third = warc.deduplicate_archives(spark, str(tmp_path / "two"), str(tmp_path / "three"))
    assert got(third) == got(again)


def test_many_members():
    record = b"WARC/1.1\r\nContent-Length: 3\r\nX: a:b\r\n\r\nabc\r\n\r\n"
    found = list(warc.parse_archive(gzip.compress(record) + gzip.compress(record * 2)))
    assert [r["block"] for r in found] == [b"abc"] * 3 and found[0]["x"] == "a:b"


def test_no_pages(spark):
    assert warc.archive_pages(pages(spark).limit(0)).collect() == []


def test_ids_that_repeat_with_other_payloads(spark):
    rows = [(1, "u", "a" * 200), (1, "u", "b" * 300), (2, "u", "a" * 200), (3, "u", "b" * 300)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    found = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or -1) for r in out)
    assert found == [(1, 200, "response", -1), (1, 300, "response", -1), (2, 200, "revisit", 1), (3, 300, "revisit", 1)]


def test_urls_keep_their_characters(spark):
    urls = ["http://a/\tb\rc\nd e\x7f\x00", "http://a/%20é?q=日本#x", "", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("html", F.lit("x"))
    got = {r.page_id: r.url for r in warc.archive_pages(df).collect()}
    assert got == {0: "http://a/%09b%0Dc%0Ad%20e%7F%00", 1: urls[1], 2: "", 3: None}


def test_headers_and_files_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 100)
    rows = [(i, f"http://h/{i}", "z" * n) for i, n in enumerate([150, 150, 150, 90, 90, 90, 90, 1000, 2000])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.archive_pages(df, path=str(tmp_path / "w"))
    sizes, records = [], []
    for f in (tmp_path / "w").rglob("*.gz"):
        own = list(warc.parse_archive(f.read_bytes()))
        sizes.append(sum(len(r["block"]) for r in own))
        records += own
    ids = [r["warc-record-id"] for r in records]
    assert len(set(ids)) == len(rows) and all(len(i) == 47 and i.startswith("<urn:uuid:") for i in ids)
    revisits = [r for r in records if r["warc-type"] == "revisit"]
    first = next(r for r in records if r["x-page-id"] == "0")
    assert len(revisits) == 2
    for r in revisits:
        assert r["warc-refers-to"] == first["warc-record-id"] and r["warc-refers-to-target-uri"] == "http://h/0"
        assert r["warc-refers-to-date"] == first["warc-date"]


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from foldspark.llm import queries

    pages(spark).where("page_id is not null").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(queries.ORACLES["op3_warc_revisits"]).fetchall()
    columns = [c[0] for c in db.description]
    got = queries.QUERIES["op3_warc_revisits"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_digests_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert got(warc.archive_pages(pages(spark))) == want()


def test_one_pass_writes_full_files(spark, tmp_path):
    rows = spark.range(0, 5000, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p" * 120), F.col("id").cast("string")).alias("html"))
    warc.archive_pages(rows, path=str(tmp_path / "w"))
    counts = sorted(len(list(warc.parse_archive(f.read_bytes()))) for f in (tmp_path / "w").rglob("*.gz"))
    assert counts == [904, 2048, 2048]
