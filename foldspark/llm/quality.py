"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of the training fold with quality 1; unlabelled texts are rows of the training fold
without a label (or labelled rows with the label hidden where every row is labelled). The class prior is the share of
positives among the labels of the whole training fold; where it has positives only, ``positive_prior`` estimates it
from positives and unlabelled rows alone. A logistic model f minimises

    prior * R_P(f, +1) + max(0, R_U(f, -1) - prior * R_P(f, -1)),

stepping against the second term alone where it turns negative. Its inputs describe the text only: shares of character
class pairs, word and line shapes, repetition. The fit uses at most ``fit_rows`` positives and as many unlabelled rows,
the first by a hash of their id, at any table size; every row is scored, over its whole text, without a shuffle.

Edge cases: null and empty texts have all-zero inputs and get that input's score. Without positives or unlabelled
rows every score is the prior (0.5 without labels). Label rows that repeat or disagree count one by one. Rows with null
ids are scored and never learnt from; of documents that repeat an id the least text is learnt from. Other columns are
ignored. An empty table gives an empty result; very long texts are described whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .scratch import cut, text_batches

#: Positives, and unlabelled rows, that a fit uses at most.
FIT_ROWS = 8000
#: Character classes: lower, upper, digit, blank, line end, full stop and comma, other sentence marks, brackets, quotes,
#: symbols, bar, bytes of other scripts.
CLASSES = 12
_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 11
for _chars, _k in ((" \t", 3), ("\n\r\v\f", 4), (".,", 5), ("!?;:", 6), ("()[]{}<>", 7), ("\"'`", 8), ("|", 10)):
    _CLASS[[ord(c) for c in _chars]] = _k
SHAPES = 9
INPUTS = CLASSES + CLASSES * CLASSES + SHAPES


def features(column: pa.Array) -> np.ndarray:
    """(texts, INPUTS) float32 description of every text."""
    out = np.zeros((len(column), INPUTS), np.float32)
    for row, end, data, offsets in W.slices(column):
        n = end - row
        size = np.diff(offsets)
        kind = _CLASS[data].astype(np.int64)
        doc = np.repeat(np.arange(n), size)
        part = out[row:end]
        per = np.maximum(size, 1)[:, None]
        part[:, :CLASSES] = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / per
        if len(kind) > 1:
            both = doc[1:] == doc[:-1]
            pairs = (doc[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
            part[:, CLASSES : CLASSES + CLASSES**2] = np.sqrt(np.bincount(pairs[both], minlength=n * CLASSES**2).reshape(n, -1) / per)
        w = W.words(data, offsets)
        words = np.diff(w.rows)
        length = w.ends - w.starts
        owner = np.repeat(np.arange(n), words)
        some = np.maximum(words, 1)
        mean = np.bincount(owner, length, n) / some
        spread = np.sqrt(np.maximum(0, np.bincount(owner, length.astype(float) ** 2, n) / some - mean**2))
        distinct = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)], float)
        ends = np.bincount(doc[data == 10], minlength=n)
        shape = part[:, -SHAPES:]
        shape[:, 0] = np.log1p(size) / 10
        shape[:, 1] = mean / 10
        shape[:, 2] = spread / 10
        shape[:, 3] = distinct / some
        shape[:, 4] = np.log1p(words) / 10
        shape[:, 5] = ends / some
        shape[:, 6] = distinct / np.sqrt(some) / 20
        shape[:, 7] = (size > 0).astype(np.float32)
        again = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        shape[:, 8] = np.bincount(owner[1:][again], minlength=n) / some
    return out


@dataclass
class Model:
    """Weights over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def positive_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, with no negatives known: the ratio of the shares of both that score
    above a bound, under a model that tells one from the other. Far up only positives are left, and the ratio falls to
    their share. The lowest bound (that with the most rows) whose ratio is within one standard deviation of the least is
    picked on one half of the rows, where bounds that fewer than a fifth of the positives pass don't count, and the
    ratio is read on the other half, so the choice among noisy ratios doesn't move it; the halves take both parts, and
    the mean counts."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = fit(positive, unlabelled, 0.5, clip=False)
    p, u = model.score(positive), model.score(unlabelled)
    rng = np.random.default_rng(0)
    p, u = rng.permutation(p), rng.permutation(u)
    ratios = []
    for half in (0, 1):
        (p0, u0), (p1, u1) = ((np.sort(p[k::2]), np.sort(u[k::2])) for k in (half, 1 - half))
        bounds = np.quantile(p0, np.linspace(0, 0.8, 81), method="lower")
        n_u, n_p = (len(x) - np.searchsorted(x, bounds, "left") for x in (u0, p0))
        ratio = (n_u / len(u0)) / (n_p / len(p0))
        upper = ratio * (1 + np.sqrt(1 / np.maximum(n_u, 1) + 1 / n_p))
        bound = bounds[(ratio <= upper.min()).argmax()]
        n_u, n_p = ((x >= bound).sum() for x in (u1, p1))
        if n_p:
            ratios.append((n_u / len(u1)) / (n_p / len(p1)))
    return float(np.clip(np.mean(ratios), 0.01, 0.99)) if ratios else 0.5


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    steps: int = 600,
    rate: float = 0.05,
    decay: float = 1e-4,
    clip: bool = True,
) -> Model:
    """Minimise the non-negative risk by full-batch Adam steps. Without ``clip``, the plain logistic risk of telling
    positives from unlabelled rows, each class with half of the weight."""
    dims = INPUTS
    if not len(positive) or not len(unlabelled) or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(dims), np.ones(dims), np.zeros(dims), float(np.log(p / (1 - p))), prior)
    mean = unlabelled.mean(0, dtype=float)
    scale = unlabelled.std(0, dtype=float) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float32) for x in (p, u))
    w = np.zeros(dims + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        hidden = prior if clip else 0.0
        negative = np.logaddexp(0, zu).mean() - hidden * np.logaddexp(0, zp).mean()
        g_negative = u.T @ sigmoid(zu) / len(u) - hidden * (p.T @ sigmoid(zp)) / len(p)
        if negative < 0:
            g = -g_negative
        else:
            g = (prior if clip else 1.0) * (p.T @ (sigmoid(zp) - 1)) / len(p) + g_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _sampled(docs: DataFrame, ids: DataFrame, fit_rows: int) -> np.ndarray:
    """Inputs of the documents with ``ids`` (at most ``fit_rows``), in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([r.tobytes() for r in features(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(run, "doc_id bigint, x binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, INPUTS)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit to ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    text_batches(docs.sparkSession)
    fold = labels.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
    total, ones = fold.agg(F.count("*"), F.sum((F.col("label") == 1).cast("int"))).first()
    prior = (ones or 0) / total if total else 0.5

    def first(ids: DataFrame) -> DataFrame:
        return cut(ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "sample")

    positive = first(fold.where("label = 1").select("doc_id"))
    known = labels.select("doc_id").distinct()
    training = docs.where(~held_out(F.col("doc_id"))).select("doc_id")
    unlabelled = first(training.join(known, "doc_id", "left_anti"))
    if unlabelled.isEmpty():
        unlabelled = first(training)
    p, u = _sampled(docs, positive, fit_rows), _sampled(docs, unlabelled, fit_rows)
    return fit(p, u, positive_prior(p, u) if ones and ones == total else prior)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``threshold``) of every row."""
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("label"))
    model = train(chosen, known, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))).astype(np.float64))], names=["doc_id", "score"])

    scored = chosen.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; fitted as in ``quality_scores``."""
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("label"))
    model = train(chosen, known, fit_rows)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
