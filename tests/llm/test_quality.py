import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out]
    assert 40 < len(held) and (held.predicted == held.quality).mean() >= 0.95
    one, zero = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (one[:, None] > zero[None, :]).mean() >= 0.97
    assert ((scored.score >= 0) & (scored.score <= 1)).all() and (scored.predicted == (scored.score >= 0.3)).all()


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.quality_scores(docs, x).toPandas().sort_values("doc_id") for x in (labels, turned))
    assert np.allclose(one.score, two.score)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(i, "good words in a row. " * 5 if i % 2 else "@@ ## $$ " * 9, "label") for i in range(60)] + [(70, None, ""), (71, "", ""), (None, "x" * 100_000, ""), (71, "", "")], "doc_id bigint, text string, label string")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (70, 71)}) == 1
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns


def test_risk_is_minimised():
    rng = np.random.default_rng(0)
    p = np.zeros((300, quality.INPUTS))
    u = np.zeros((600, quality.INPUTS))
    p[:, 0], u[:, 0] = rng.normal(1, 0.4, 300), np.r_[rng.normal(1, 0.4, 400), rng.normal(-1, 0.4, 200)]
    model = quality.fit(p, u, 2 / 3)
    assert model.score(u[:400]).mean() > 0.9 and model.score(u[400:]).mean() < 0.2


def nonnegative_risk(w, b, p, u, prior):
    """The risk by its definition, one example at a time."""
    loss = lambda z: np.log(1 + np.exp(-z))
    zp, zu = (np.array([sum(a * c for a, c in zip(x, w)) + b for x in rows]) for rows in (p, u))
    return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean())


@pytest.mark.parametrize("overlap", [0.6, 1.5])
def test_the_fit_is_a_minimum_of_the_risk(overlap):
    rng = np.random.default_rng(1)
    p, u = np.zeros((400, quality.INPUTS)), np.zeros((900, quality.INPUTS))
    p[:, :2] = rng.normal([1, -1], overlap, (400, 2))
    u[:, :2] = np.r_[rng.normal([1, -1], overlap, (300, 2)), rng.normal([-1, 1], overlap, (600, 2))]
    model = quality.fit(p, u, 1 / 3, decay=0)
    x, y = ((v - model.mean) / model.scale for v in (p, u))
    own = nonnegative_risk(model.weights[:2], model.bias, x[:, :2], y[:, :2], 1 / 3)
    assert own < nonnegative_risk([0, 0], np.log(0.5), x[:, :2], y[:, :2], 1 / 3) - 0.05
    for _ in range(20):
        dw, db = rng.normal(0, 0.3, 2), rng.normal(0, 0.3)
        assert own <= nonnegative_risk(model.weights[:2] + dw, model.bias + db, x[:, :2], y[:, :2], 1 / 3) + 0.01


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_of_positives_and_unlabelled(prior):
    rng = np.random.default_rng(2)
    draw = lambda n, at: np.c_[rng.normal(at, 0.5, (n, 1)), np.zeros((n, quality.INPUTS - 1))]
    u = np.r_[draw(int(2000 * prior), 1), draw(2000 - int(2000 * prior), -1)]
    assert abs(quality.positive_prior(draw(1500, 1), u) - prior) < 0.1


def test_positive_labels_alone(spark):
    rows = [(i, "good words in a row. " * (i % 5 + 3) if i % 2 else "@@ ## $$ " * (i % 7 + 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 200, 2)], "doc_id bigint, quality int")
    scored = quality.quality_scores(docs, labels).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in scored]) > 0.95
