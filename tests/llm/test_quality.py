"""Operator 13: held-out accuracy, the fit against one by hand, and odd rows."""

import zlib

import numpy as np
import pytest

from tidewright.llm.quality import FEATURES, Discriminant, described, features, fitted, quality
from tidewright.llm.text_queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in QUERIES["op13_quality"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(labels[i], r.predicted, r.score) for i, r in found.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b, _ in out]) > 0.97
    good, bad = ([s for a, _, s in out if a == k] for k in (1, 0))
    assert np.mean([[x > y for y in bad] for x in good]) > 0.98


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    one, two = (dict(map(lambda r: (r.doc_id, r.score), quality(docs.drop("lang", "source"), x).collect())) for x in (labels, turned))
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-9) for i in one)


def test_fit_is_the_one_by_hand(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = described(docs).join(labels, "doc_id").selectExpr("quality as label", "features").collect()
    model = fitted(spark.createDataFrame(rows, "label int, features array<double>").repartition(5))
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    pooled = sum((y == k).mean() * np.cov(x[y == k].T, bias=True) for k in (0, 1))
    density = []
    for k in (0, 1):
        s = 0.5 * np.cov(x[y == k].T, bias=True) + 0.5 * pooled
        s = (0.9 * s + 0.1 * np.diag(np.diag(s)))[np.ix_(model.used, model.used)]
        z = (x - x[y == k].mean(0))[:, model.used]
        density.append(np.log((y == k).mean()) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))), abs=1e-6)


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, features string, label string"
    texts = [None, "", " \n ", "x" * 5000, "word " * 40000, "日本語 🎉", "same text here", "same text here", "12 34 5", "A"]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)] + [(None, "no id", "", "", ""), (3, "again", "", "", "")], schema)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(10)] + [(None, 1, 1), (99, 1, 1), (5, None, 1), (6, 7, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted([*map(str, range(10)), "None", "3"]) and all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert {r.score for r in quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality(docs, labels.where("quality = 0")).collect()} == {0.0}
    assert {r.score for r in quality(docs, labels.where("quality = 7")).collect()} == {0.5}
    assert quality(docs.where("doc_id > 1000"), labels).count() == 0


def test_features_are_finite_and_see_whole_texts():
    for text in [None, "", "a", "#" * 9, "\n\n", "\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace"), "The cat. " * 9000]:
        assert len(features(text)) == len(FEATURES) and np.isfinite(features(text)).all()
    calm = "The cat sat on a mat with ten others. " * 3000
    assert features(calm) != features(calm + "### $$$ %%%")


def test_constant_features_decide_nothing():
    x = np.random.default_rng(1).normal(size=(50, 3))
    x[:, 1] = 4.0
    sums = {k: (25.0, part.sum(0), part.T @ part) for k, part in ((0, x[:25]), (1, x[25:] + [2.0, 0.0, 0.0]))}
    model = Discriminant.of(sums)
    assert model.used.tolist() == [0, 2] and np.isfinite(model.scores(x)).all()
