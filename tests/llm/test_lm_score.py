import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lm_score as L


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def brute(rows):
    """The same model by dictionaries, one text at a time."""
    c1, c2, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            starts += 1
            c1.update(w)
            c2.update(zip(["^", *w], w))
    total, distinct = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.1) / (total + 0.1 * (distinct + 1))
    ctx = lambda h: starts if h == "^" else c1[h]
    hist = np.zeros((L.CLASSES, L.RATIO_BINS))
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            for h, x in zip(["^", *w], w):
                n, c = ctx(h) - 1, c2[h, x] - 1
                if n > 0:
                    b = 0 if c <= 0 else int(np.clip(math.floor((math.log10(c / n / p1(x)) - L.RATIO_LOW) / L.RATIO_STEP) + 1, 1, L.RATIO_BINS - 1))
                    hist[int(L.size_class(np.array([n]))[0]), b] += 1
    weights = L.fit_weights(hist)
    out = {}
    for i, t in rows:
        w = tokens(t)
        score = 0.0
        for h, x in zip(["^", *w], w):
            n = ctx(h)
            lam = weights[int(L.size_class(np.array([n]))[0])] if n else 0.0
            score += math.log10((lam * c2[h, x] / n if n else 0) + (1 - lam) * p1(x))
        out[i] = (held(i), len(w), sum(c1[x] > 0 for x in w), total, sum(math.log10(p1(x)) for x in w), score)
    return out


def sample():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    chain = {w: r.choices(vocabulary, k=3) for w in vocabulary}

    def text():
        w, out = r.choice(vocabulary), []
        for _ in range(r.randint(1, 80)):
            out.append(w)
            w = r.choice(chain[w])
        return " ".join(out)

    return [(i, text()) for i in range(150)] + [(900, None), (901, ""), (902, " \t\x0b"), (903, "Q W1 w1\nÉ\x1c"), (904, "w1 " * 3000), (None, "w1 w2")]


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    want = brute(rows)
    for block_chars in (700, 1 << 20):
        got = L.lm_score(df, block_chars=block_chars).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r["doc_id"]]
            assert tuple(r)[1:5] == w[:4]
            assert math.isclose(r["base_score"], w[4], rel_tol=1e-9)
            assert math.isclose(r["score"], w[5], rel_tol=1e-9)
    gain = [r["score"] - r["base_score"] for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert gain and sum(gain) > 0


def test_held_out_probes(spark):
    """Known, unseen and missing next words after a known one, in texts that are not learned from."""
    rows = [(i, "a b a c b") for i in range(1, 9)]
    probes = [(1000 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "zzz"])] + [(1004, "a")]
    while any(not held(i) for i, _ in probes):
        probes = [(i if held(i) else i + 5, t) for i, t in probes]
    got = {r["doc_id"]: r["score"] for r in L.lm_score(spark.createDataFrame(rows + probes, "doc_id long, text string")).collect()}
    ids = {t: i for i, t in probes}
    want = brute(rows + probes)
    assert all(math.isclose(got[i], want[i][5], rel_tol=1e-9) for i in ids.values())


def test_empty(spark):
    assert L.lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
