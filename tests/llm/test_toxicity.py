import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T


def corpus():
    r = random.Random(0)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = ". ".join(" ".join(r.choice(words) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 12))) + ".\nLast line"
        toxic = r.random() < 0.2
        if toxic:
            text = text.replace("Last line", f"you {r.choice(['vile', 'rotten'])}, w1 thing!")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows + [(1000, None), (1001, ""), (1002, " \n\n "), (1003, "vile " * 20_000)], labels


def test_held_out_accuracy_and_places(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "label": F.lit(1)})
    known = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.score_documents(docs, known).collect()}
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 80 and all(got[i]["predicted"] == truth[i] for i in held)
    for i, text in rows:
        if i in truth and truth[i]:
            assert got[i]["offending_sentences"] == [got[i]["n_sentences"] - 1], text
    assert all(got[i]["predicted"] == 0 and got[i]["score"] < 0.01 for i in (1000, 1001, 1002))
    assert got[1003]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got.values())


def test_noisy_or():
    p, doc = np.array([0.1, 0.5, 0.2]), np.array([0, 0, 2])
    assert np.allclose(T.noisy_or(p, doc, 4), [1 - 0.9 * 0.5, 0, 0.2, 0])


def test_sentences():
    s = T.Sentences(pa.array(["skip", "One two. Three!\nfour five", None, "x? 'y.' z"]).slice(1))
    assert s.doc.tolist() == [0, 0, 0, 2, 2, 2] and s.number().tolist() == [0, 1, 2, 0, 1, 2]


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in T.score_documents(docs, none).collect()] == [0.0, 0.0]
    assert T.score_documents(docs.limit(0), none).count() == 0
