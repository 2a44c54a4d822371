import random

import numpy as np

from tidemark.llm import quality_knn as Q
from tidemark.llm.common import crc_remainder


def test_vote_is_exact():
    r = np.random.default_rng(0)
    x, y = np.abs(r.normal(size=(300, Q.TERMS))).astype(np.float32), r.integers(0, 2, 300)
    model = Q.fit(x, y, {0: 700, 1: 300})
    probe = np.abs(r.normal(size=(20, Q.TERMS))).astype(np.float32)
    got = Q.vote(probe, model)
    v = Q.project(probe, model.weights, model.axes)
    for k in range(20):
        cosine = model.vectors @ v[k]
        near = np.argsort(-cosine)[: Q.NEIGHBOURS]
        w = np.maximum(cosine[near], 0).astype(float) ** Q.SHARPNESS * np.where(y[near] == 1, 0.3 / y.sum(), 0.7 / (len(y) - y.sum()))
        assert np.isclose(got[k], (w * y[near]).sum() / w.sum(), rtol=1e-4)


def test_held_out_accuracy(spark):
    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "btkm" for b in "aeiou" for c in "nrls"]
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randint(15, 60))]
        bad = i % 4 == 0
        if bad:
            w = [[x.upper() + "!!" for x in w], [x for x in w for _ in range(4)], [f"{x} |" for x in w]][i // 4 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    rows += [(900, None), (901, ""), (902, "word " * 20_000), (903, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame(labels + [(7, None, 0)], "doc_id long, quality int, toxic int"), crc_remainder("doc_id", 5) != 0)
    got = {x["doc_id"]: x for x in Q.quality_scores(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    held = {x["doc_id"] for x in docs.where(crc_remainder("doc_id", 5) == 0).collect()}
    wrong = [i for i, q, _ in labels if i in held and got[i]["predicted"] != q]
    assert len(held) > 60 and len(wrong) <= 2
    assert got[900]["score"] == got[901]["score"] == model.share


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), crc_remainder("doc_id", 5) != 0)
    assert Q.quality_scores(docs, model).collect()[0]["score"] == 0.5
    assert Q.quality_scores(docs.limit(0), model).count() == 0
