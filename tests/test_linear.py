"""The factored trainer finds what pyspark.ml finds, without a vector per example."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlake.operators import linear

TEXTS = {"a": [(0, 0.6), (2, 0.8)], "b": [(1, 1.0)], "c": [(0, 0.3), (1, 0.5), (3, 0.2)], "": []}


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    texts = rng.choice(list(TEXTS), n)
    numbers = np.stack([rng.normal(4, 2, n), rng.random(n), np.full(n, 1.0)], axis=1)
    labels = (numbers[:, 0] > 4) + (texts == "b") + 2 * (rng.random(n) < 0.2)
    return [(str(t), int(y), 0.5 + 0.25 * int(y), [float(v) for v in x]) for t, y, x in zip(texts, labels, numbers)]


def fitted(spark, rows, labels, max_iter=25, path=None):
    examples = spark.createDataFrame(rows, "text string, label int, weight double, tail array<double>")
    terms = spark.createDataFrame([(k, v) for k, v in TEXTS.items() if v], "text string, terms array<struct<idx:int,weight:double>>")
    stored = linear.blocks(examples, terms, 3)
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, linear.fit(stored, 4, 3, labels, max_iter, 1e-3)


def test_coefficients_are_those_of_pyspark(spark, tmp_path):
    rows = made(400)
    rows += rows[:50]  # equal examples
    _, (weights, intercepts) = fitted(spark, rows, 5, path=str(tmp_path / "b"))
    vectors = [(Vectors.sparse(7, sorted((dict(TEXTS[t]) | {4 + i: v for i, v in enumerate(x)}).items())), float(y), w) for t, y, w, x in rows]
    wanted = OneVsRest(classifier=LogisticRegression(maxIter=25, regParam=1e-3, weightCol="weight"), weightCol="weight").fit(
        spark.createDataFrame(vectors, ["features", "label", "weight"]))
    for j, m in enumerate(wanted.models):
        assert np.abs(m.coefficients.toArray() - weights[j]).max() < 1e-6
        assert m.intercept == pytest.approx(intercepts[j], abs=1e-6)
    assert intercepts[4] == float("-inf") and not weights[4].any()


def test_terms_are_stored_per_block_not_per_example(spark, tmp_path):
    rows = [("a", i % 2, 1.0, [float(i), 0.0, 1.0]) for i in range(20_000)]
    rows += [("b", 1, 2.0, [1.0, 1.0, 1.0])] * 5_000  # one example, however often
    stored, (weights, intercepts) = fitted(spark, rows, 2, max_iter=3, path=str(tmp_path / "b"))
    found = stored.select(F.sum(F.size("indices")), F.max(F.size("labels")), F.sum(F.size("labels")), F.sum(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))).first()
    assert found[0] < 400 and found[1] < 1000 and found[2] == 20_001 and found[3] == 30_000
    assert np.isfinite(weights).all() and np.isfinite(intercepts).all()


def test_a_single_label_and_no_examples(spark, tmp_path):
    _, (_, intercepts) = fitted(spark, [("a", 1, 1.0, [1.0, 2.0, 3.0])] * 3, 3, path=str(tmp_path / "b"))
    assert intercepts.tolist() == [float("-inf"), float("inf"), float("-inf")]
    _, (weights, intercepts) = fitted(spark, [], 2, path=str(tmp_path / "c"))
    assert not weights.any() and intercepts.tolist() == [float("-inf")] * 2
