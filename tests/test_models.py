import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import claims, classify, models

ASKED = []


def length_embedder(name):
    ASKED.append(name)
    return lambda texts: [[len(t), t.count("a"), 1.0] for t in texts]


def length_classifier(name):
    return lambda texts: [[0.0, len(t) - 3.0] for t in texts]


def parser(name):
    return lambda texts: [([w for w in t.split() if w[:1].isupper()], "is" in t.split(), False, True) for t in texts]


HERE = __name__


@pytest.fixture(autouse=True)
def importable(spark):
    """Workers import this module by name."""
    import os

    spark.sparkContext.addPyFile(os.path.abspath(__file__))


def test_embeddings(spark):
    model = models.EmbeddingModel("toy", f"{HERE}:length_embedder", dims=3, batch=2)
    rows = spark.createDataFrame([(1, " abc "), (2, None), (3, ""), (4, "aaaa"), (5, "b")], "id int, text string")
    got = {r.id: r.e for r in rows.withColumn("e", model(F.col("text"))).collect()}
    assert got[2] == got[3] == [0.0, 0.0, 0.0] and got[1] == pytest.approx(np.array([3, 1, 1]) / np.sqrt(11))
    assert np.linalg.norm(got[4]) == pytest.approx(1)
    raw = models.EmbeddingModel("toy", f"{HERE}:length_embedder", dims=3, normalise=False).encode(["ab", None])
    assert raw.tolist() == [[2, 1, 1], [0, 0, 0]]
    models.loaded.cache_clear()
    ASKED.clear()
    for _ in range(3):
        model.encode(["x"])
    assert ASKED == ["toy"]


def test_classifier_and_parser(spark):
    model = models.SequenceModel("toy", f"{HERE}:length_classifier", labels=("FAKE", "real"))
    rows = spark.createDataFrame([(1, "abcdef", 6), (1, "a", 1), (2, None, 0)], "doc_id int, text string, weight int")
    got = {r.doc_id: r for r in classify.classify_with(rows, model).collect()}
    p = 1 / (1 + np.exp(-3))
    assert got[1].real_probability == pytest.approx((6 * p + 1 / (1 + np.exp(2))) / 7, abs=1e-4)
    assert got[2].real_probability == pytest.approx(1 / (1 + np.exp(3)), abs=1e-4)
    parsed = claims.rule_analysis(rows.withColumn("text", F.lit("Ana is here")), parser=models.LanguageModel("toy", f"{HERE}:parser")).first()
    assert parsed.entities == ["Ana"] and parsed.indicative and not parsed.modal and parsed.has_subject
