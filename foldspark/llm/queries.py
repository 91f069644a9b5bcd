"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann
from .alignment import aligned_tokens
from .decontam import contaminated
from .importance import resample
from .licenses import scan_licenses
from .neardup import near_duplicates
from .pieces import encode_documents
from .quality import quality_scores
from .secrets import find_secrets
from .sharding import assign_shards
from .tokenfiles import tokens_written_and_read
from .urlfilter import PATTERNS, filter_urls, host_rule
from .warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@_query
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"), min_bytes=100)


@_query
def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, similarity=(80, 100))


@_query
def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


URL_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]


@_query
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


@_query
def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op10_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op11_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_written_and_read(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


# SQL twins of the queries that SQL can express.

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op3_warc_revisits"] = """
with q as (select page_id, url, cast(strlen(coalesce(html, '')) as bigint) as n, sha256(coalesce(html, '')) as digest from pages),
m as (select digest, min(page_id) as first from q where n >= 100 group by digest)
select page_id, n as payload_bytes, q.digest as payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to,
  list_aggregate(list_transform(string_split(url, ''), lambda c: case when c <> '' and (ord(c) <= 32 or ord(c) = 127) then '%' || upper(lpad(to_hex(ord(c)), 2, '0')) else c end), 'string_agg', '') as url
from q left join m on m.digest = q.digest and q.n >= 100"""

ORACLES["op4_minhash_odd_sketch"] = f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end)) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 80 * (a.n + b.n - k)),
e as (select u, v from l union select v, u from l),
t as (with recursive r(u, v) as (select u, v from e union select r.u, e.v from r join e on e.u = r.v) select u, min(v) as v from r group by u)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(w.doc_id, coalesce(t.v, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(t.v, w.doc_id)) as kept
from w left join n using (doc_id) left join t on t.u = w.doc_id"""


def _url_sql() -> str:
    hosts = sorted(enumerate(URL_RULES), key=lambda x: (-len(x[1].text), -x[0]))

    def fits(text: str) -> str:
        host, _, path = text.partition("/")
        return f"(host = '{host}' or host like '%.{host}') and starts_with(path, '/{path}')"

    rule = " ".join(f"when {fits(r.text)} then '{r.text}'" for _, r in hosts)
    action = " ".join(f"when {fits(r.text)} then '{r.action}'" for _, r in hosts)
    found = ", ".join(f"case when regexp_matches(lower(url), '{r.text}') then '{r.text}' end" for r in PATTERNS)
    return f"""
with h as (select page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
p as (select *, least({found}) as pattern from h)
select page_id, host, path, case {rule} end as rule, case {action} when pattern is not null then 'block' else 'allow' end as verdict, pattern from p"""


ORACLES["op7_url_rules"] = _url_sql()

#: A word's CRC is computed byte by byte with the usual table of 256 entries (polynomial 0xEDB88320), once for each
#: distinct word.
ORACLES["op12_importance_resampling"] = f"""
with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') as ws from benchmark),
dw as (select doc_id, unnest(ws) as word from w), bw as (select unnest(ws) as word from b),
words as (select word from dw union select word from bw),
crc as (select word, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(strlen(word)), lambda i: cast('0x' || substring(hex(encode(word)), 2 * i + 1, 2) as bigint))),
  lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 as bucket from words, tab),
s as (select bucket, count(*) as n from dw join crc using (word) group by bucket), t as (select bucket, count(*) as n from bw join crc using (word) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s)::double + 10000) / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from t)::double + 10000)))) as bigint) as gain
  from s left join t using (bucket)),
m as (select doc_id, count(*) as n, floor(sum(gain)::double / count(*)) as weight from dw join crc using (word) join g using (bucket) group by doc_id),
d as (select doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast('0x' || substring(sha256('2024:' || doc_id), 1, 8) as bigint) as h from w left join m using (doc_id)),
e as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from d),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from e where n_features >= 20)
select e.doc_id, n_features, weight, score, case when rank <= 10 * able // 100 then rank end as rank from e left join r using (doc_id)"""
