"""Toxicity by held-out accuracy, unseen spellings, and odd rows."""

import numpy as np
import pytest

from linkloom.llm import toxicity
from linkloom.llm.base import QUERIES


def auc(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, path).toPandas()
    labels = spark.read.parquet(f"{path}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count() and rows.score.between(0, 1).all()
    both = rows.merge(labels, on="doc_id")
    test = both[both.held_out]
    assert len(test) > 300
    assert auc(test.toxic.to_numpy(), test.score.to_numpy()) > 0.95
    hit = test[test.toxic == 1].predicted.mean()
    wrong = test[test.toxic == 0].predicted.mean()
    assert hit > 0.85 and wrong < 0.05


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioubcdfgl"), 5)) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        own = list(rng.choice(words, 40))
        if k % 2:
            own[7] = "wretched"
        texts.append((k, " ".join(own)))
        labels.append((k, k % 2))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return words, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_unseen_misspelling_and_odd_rows(spark, model):
    words, fitted = model
    plain = " ".join(words[:40])
    rows = [(1, plain, "s"), (2, plain + " wretchedd", None), (3, "", "s"), (4, None, "s"), (5, "?!", "s"), (None, plain, "s"), (1, plain, "s"), (7, plain * 2000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.scored(docs, fitted, ["doc_id", "score"]).collect()
    assert len(got) == len(rows)
    scores = [r.score for r in got]
    assert scores[1] > scores[0] + 0.2
    assert scores[2] == scores[3] == scores[4]
    assert scores[0] == scores[5] == scores[6]
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(docs.limit(0), fitted, ["doc_id"]).count() == 0


def test_no_usable_label(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 5)], "doc_id long, toxic int")
    row = toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]).first()
    assert abs(row.score - 0.5) < 0.05


def test_folding_equals_the_softmax():
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=(1 << toxicity.BUCKET_BITS, toxicity.WIDTH)), rng.normal(size=(toxicity.WIDTH, 2)), np.array([0.3, -0.1]))
    found = toxicity.buckets("some words here")
    logits = m.vectors[found].mean(0) @ m.output + m.bias
    folded, bias = m.folded()
    assert abs((logits[1] - logits[0]) - (folded[found].mean(dtype=float) + bias)) < 1e-5


def test_a_repeated_document_adds_one_row(spark, monkeypatch):
    """The sample is bounded after the join: copies of a row reach the driver once."""
    rows = [(k, f"word{k} other{k % 3} text") for k in range(20)] + [(3, "word3 other0 text")] * 500 + [(4, f"text number {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 1)] * 5, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda got, keys, counts, share: seen.append((list(got), len(keys))))
    toxicity.train(docs, labels)
    assert seen[-1][1] == 10 + 9 + 301
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 15)
    toxicity.train(docs, labels)
    assert seen[-1][0].count(0) == 15 and seen[-1][0].count(1) == 10
