import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import quality as Q


def make(n=240):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["word" + "abcdefgh"[j] for j in rng.integers(0, 8, 40)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", "src", "clash"))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, stat_upper string"


def test_rules_separate_held_out_rows_and_columns_agree_with_numpy(spark):
    docs, labels = make()
    d = spark.createDataFrame(docs + [(900, None, None, None, None), (901, "", None, None, None), (None, "x " * 50_000, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels + [(902, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(d, lab)
    assert model.rules and all(model.weights)
    out = Q.score_quality(d, model)
    assert out.columns == [*d.columns, "score"]
    rows = out.select("doc_id", "score", *[c.alias(f"s{i}") for i, c in enumerate(Q.statistics(F.col("text")).values())]).toPandas()
    names = list(Q.statistics(F.col("text")))
    x = rows[[f"s{i}" for i in range(len(names))]].to_numpy(float)
    assert np.allclose(model.score(names, x), rows["score"])
    score = dict(zip(rows["doc_id"], rows["score"]))
    assert all((score[i] >= 0.7) == bool(q) for i, q, _ in labels)
    assert all(0 <= s <= 1 for s in score.values()) and len(rows) == len(docs) + 3
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, q, _ in labels if q}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = make(120)
    d = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from cellweave.llm.common import remainder

    flipped = lab.withColumn("quality", F.when(remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.train(d, lab) == Q.train(d, flipped)


@pytest.mark.parametrize("y", [[], [1] * 30, [0] * 30])
def test_one_class_or_none_is_a_constant(y):
    model = Q.fit_rules(np.zeros((len(y), 2)), np.array(y, float), ["a", "b"])
    assert not model.rules
    p = model.score(["a", "b"], np.zeros((1, 2)))[0]
    assert (p >= 0.7) == (not y or y[0] == 1)


def test_lasso_drops_columns_that_do_not_matter():
    rng = np.random.default_rng(1)
    r = (rng.random((800, 12)) > 0.5).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(3 * r[:, 0] - 3 * r[:, 1])))).astype(float)
    w, _ = Q._lasso(r, y, 0.03, (np.zeros(12), 0.0), steps=500)
    assert w[0] > 0.5 and w[1] < -0.5 and np.abs(w[2:]).max() < 1e-6


def test_conjunctions_are_found():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    model = Q.fit_rules(x[:400], y[:400], list("abcd"))
    assert ((model.score(list("abcd"), x[400:]) >= 0.5) == y[400:]).mean() > 0.95
