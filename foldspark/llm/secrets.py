"""Secret scans: patterned secrets, and a token-efficiency test for random strings.

A random string breaks a byte-pair vocabulary: it needs many tokens for its characters. Every unbroken run of key
characters is cut at its separators ``/ . = + - _`` and each part is encoded with a tiktoken vocabulary. Neighbouring
parts are joined to the stretch with the most tokens beyond one for ``max_ratio`` characters, so readable text before or
after a random string does not dilute it (unless no separator lies between them). A stretch of at least ``MIN_CHARS`` is
a ``random`` span, whatever letters and digits it has: words and identifiers have more characters a token. (At 16
characters instead of 20 clean texts have false spans.) Known digests (hex of a usual digest length, UUID) and patterned
spans break a run.

Spans are half-open ranges of code points. Edge cases: null and empty texts have no spans; equal rows give equal rows;
texts are scanned whole, one at a time; other columns are ignored, whatever their names. An empty table gives an empty
result. Spans that start together are listed in the order of their kinds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_batches

KINDS = ("assign", "access", "hex", "random")
#: The patterned kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
DIGEST = re.compile(r"(?<![0-9a-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?![0-9a-z])", re.IGNORECASE)
PART = re.compile(r"[A-Za-z0-9]+")
#: Parts that say nothing: short, of letters in one case pattern or of digits.
SHORT = re.compile(r"[A-Z]?[a-z]{1,3}|[A-Z]{1,3}|[0-9]{1,4}|[Vv][0-9]{1,2}")
#: Characters of the shortest random span.
MIN_CHARS = 20


@dataclass(frozen=True)
class Span:
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


_encoders: dict[str, object] = {}


def encoder(vocabulary: str, pattern: str):
    """The tiktoken encoding of a rank file; one for each worker process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def patterned(text: str) -> list[Span]:
    """Spans of the patterned kinds, leftmost and non-overlapping within a kind."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, s.kind))


def joined(spans: list[Span]) -> list[tuple[int, int, int]]:
    """The union of ``spans``, which are in order of their starts: (start, end, kind of the first) of each piece."""
    out: list[list[int]] = []
    for s in spans:
        if out and s.start < out[-1][1]:
            out[-1][1] = max(out[-1][1], s.end)
        else:
            out.append([s.start, s.end, s.kind])
    return [tuple(x) for x in out]


def stretches(run: str, encode, max_ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of whole parts of ``run`` that have fewer than ``max_ratio`` characters a token, the worst of each
    group of neighbours that stays below it. Short plain parts count for nothing and do not start or end a stretch,
    but are kept where ``-``, ``_`` or ``+`` joins them to it, or ``/`` if the stretch has ``+`` or ``/`` inside."""

    def tokens(part: str) -> int:
        """Capital letters count as the small ones: vocabularies hold few words of capitals."""
        n = len(encode(part))
        return min(n, len(encode(part.lower()))) if part.isalpha() and part.isupper() else n

    parts = [(m.start(), m.end()) for m in PART.finditer(run)]
    excess = [0.0 if SHORT.fullmatch(run, a, b) else max_ratio * tokens(run[a:b]) - (b - a) for a, b in parts]
    at = 0
    while at < len(parts):
        if excess[at] <= 0:
            at += 1
            continue
        total, best, last, stop = 0.0, 0.0, at, at
        while stop < len(parts) and total + excess[stop] > 0:
            total += excess[stop]
            if total > best:
                best, last = total, stop
            stop += 1
        first, end = at, last
        signs = "-_+/" if set("+/") & set(run[parts[at][0] : parts[last][1]]) else "-_+"
        while first > 0 and excess[first - 1] == 0 and set(run[parts[first - 1][1] : parts[first][0]]) <= set(signs):
            first -= 1
        while end + 1 < len(parts) and excess[end + 1] == 0 and set(run[parts[end][1] : parts[end + 1][0]]) <= set(signs):
            end += 1
        yield parts[first][0], parts[end][1]
        at = end + 1


def inefficient(text: str, taken: list[Span], encode, max_ratio: float) -> list[Span]:
    """Spans of stretches with few characters a token, beside the spans in ``taken``."""
    found = []
    held = joined(taken)
    stops, at_span = [end for _, end, _ in held], 0
    for m in RUN.finditer(text):
        at_span = bisect_right(stops, m.start(), at_span)
        breaks = [(a, b) for a, b, _ in takewhile(lambda x: x[0] < m.end(), islice(held, at_span, None))]
        breaks += [d.span() for d in DIGEST.finditer(text, m.start(), m.end())]
        at = m.start()
        for stop, after in [*sorted(breaks), (m.end(), m.end())]:
            piece = text[at : max(at, stop)]
            if len(piece) >= MIN_CHARS:
                found += [Span(at + a, 3, at + b) for a, b in stretches(piece, encode, max_ratio) if b - a >= MIN_CHARS]
            at = max(at, after)
    return found


def find_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    max_ratio: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    redact: bool = False,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row; ``redact`` adds ``redacted``.

    ``spans`` lists kind:start:end by start and kind, comma-joined; ``base_sha256`` is the digest of that list without
    the random kind. ``redacted`` is the text with every span replaced by ``[kind]`` (spans that touch become one), and
    null where nothing was found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = patterned(text)
                extra = inefficient(text, base, encode, max_ratio)
                spans = sorted(base + extra, key=lambda s: (s.start, s.kind))
                kinds = [s.kind for s in spans]
                digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                clean = replaced(text, spans) if redact and spans else None
                counts = (kinds.count(k) for k in range(3))
                rows.append((*counts, digest, ",".join(map(str, spans)), kinds.count(3), clean))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "redacted"]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + redact], names=names[: 7 + redact])

    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    return chosen.mapInArrow(run, schema + ", redacted string" * redact)


def replaced(text: str, spans: list[Span]) -> str:
    """``text`` with the union of ``spans`` replaced by the kind of the first span of each piece."""
    out, at = [], 0
    for start, end, kind in joined(spans):
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    max_ratio: float = 2.0,
    text_col: str = "text",
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets, and the number of characters set anew there."""
    place = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            texts, changed = batch.column(place).to_pylist(), False
            counts = batch.column(chars).to_pylist() if chars is not None else []
            for i, text in enumerate(texts):
                base = patterned(text or "")
                if spans := base + inefficient(text or "", base, encode, max_ratio):
                    texts[i], changed = replaced(text, sorted(spans, key=lambda s: (s.start, s.kind))), True
                    if counts:
                        counts[i] = len(texts[i])
            if changed:
                columns = batch.columns
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                if counts:
                    columns[chars] = pa.array(counts, batch.schema.field(chars).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
