import itertools
import random

import numpy as np

from tidemark.llm import language_id as L
from tidemark.llm.common import crc_remainder


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    scores = r.normal(size=(6, 3)) * 3
    offsets = np.array([0, 5, 5, 6, 10])
    codes = r.integers(0, 6, 10)
    label = L.viterbi(scores, codes, offsets, switch=2.0)
    value = lambda path, own: sum(scores[c, p] for c, p in zip(own, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for a, e in zip(offsets, offsets[1:]):
        if e > a:
            best = max(value(p, codes[a:e]) for p in itertools.product(range(3), repeat=int(e - a)))
            assert np.isclose(value(label[a:e], codes[a:e]), best)


def sample():
    r = random.Random(0)
    parts = {"aa": ["the", "ing", "sh", "wh", "ea"], "bb": ["sch", "ung", "ü", "ei", "pf"], "cc": ["мо", "ре", "ка", "ль"], "dd": ["жо", "ре", "ыт", "ль"]}
    word = lambda k: "".join(r.choice(parts[k]) for _ in range(r.randint(1, 4)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, text(k, r.randint(4, 60)), k) for i, k in enumerate(r.choice("abcd") * 2 for _ in range(400))]
    mixed = [(1000, text("aa", 12) + " 12 " + text("cc", 30), None), (1001, "123 !?", "aa"), (1002, None, "bb"), (1003, text("bb", 20_000), None), (1004, "日本語", None)]
    return rows, mixed


def test_held_out_accuracy_and_spans(spark):
    rows, mixed = sample()
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    model = L.train(docs, crc_remainder("doc_id", 5) != 0)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows) + len(mixed)
    assert sum(got[i]["lang_pred"] != k for i, _, k in rows) <= 4
    spans = got[1000]["spans"]
    assert [s["lang"] for s in spans] == ["aa", "cc"] and spans[0]["words"] in (12, 13) and got[1000]["lang_pred"] == "cc" and 0.5 < got[1000]["score"] < 1
    assert [tuple(got[i])[1:3] for i in (1001, 1002)] == [("und", 0.0)] * 2
    assert got[1003]["lang_pred"] == "bb" and got[1004]["lang_pred"] in model.languages


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = L.train(docs, crc_remainder("doc_id", 5) != 9)
    assert L.identify(docs, model).collect()[0]["lang_pred"] == "und"
    assert L.identify(docs.limit(0), model).count() == 0
