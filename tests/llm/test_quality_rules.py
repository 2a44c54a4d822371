import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(5)
    out = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "é ü 😀\n\n#*$ %&|<>", "l\nl\n l\nl", "\x0b\x0c\r" * 3, "w " * 30_000]
    out += [" ".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(60)]
    return out


def test_statistics(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit(-1), "_x": F.lit("clash")})
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.text_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    for i, t in rows:
        assert got[i] == brute(t), t


def test_consistency_factor():
    from statistics import mean

    x = np.random.default_rng(0).normal(size=(200_000, 3))
    d = (x**2).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert math.isclose(Q.consistency(3, 0.75) * mean(near.var(0)), 1, rel_tol=0.02)


def fit_by_numpy(x, steps=Q.STEPS, h=Q.H):
    floors = np.array(list(Q.FLOORS.values()))
    q = np.sort(x, axis=0)
    at = lambda f: q[int(np.ceil(f * len(x))) - 1]
    m, c = at(0.5), np.diag(np.maximum((at(0.75) - at(0.25)) / 1.349, floors) ** 2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        b = np.floor(np.log(d + 1e-6) * Q.BINS_PER_UNIT)
        near = x[b <= np.sort(b)[int(np.ceil(h * len(x))) - 1]]
        m, c = near.mean(0), Q.consistency(x.shape[1], h) * np.cov(near.T, bias=True) + np.diag(floors**2)
    return m, np.linalg.cholesky(c)


def test_mcd_against_numpy(spark):
    r = np.random.default_rng(1)
    p = len(Q.FLOORS)
    x = r.normal(size=(1500, p)) @ r.normal(size=(p, p)) + 3
    x[:200] += 40
    rows = [("a", *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{n} double" for n in Q.FLOORS))
    (got,) = Q.mcd_fit(df).collect()
    m, low = fit_by_numpy(x)
    assert np.allclose([got[f"m_{i}"] for i in range(p)], m, rtol=1e-3, atol=1e-3)
    assert np.allclose([got[f"l_{i}_{j}"] for i in range(p) for j in range(i + 1)], [low[i, j] for i in range(p) for j in range(i + 1)], rtol=1e-2, atol=1e-2)
    assert np.all(np.abs(m - 3) < 1)


def test_verdicts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiourstn") for _ in range(r.randint(2, 9)))
    clean = [" ".join(word() for _ in range(r.randint(12, 120))) + "." for _ in range(400)]
    bad = [" ".join(word().upper() + "$$$ ###" for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "en", "hot" if i % 3 else None) for i, t in enumerate(clean + bad)] + [(900, None, None, None), (901, "too few", "en", "hot")]
    got = {x["doc_id"]: x for x in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(len(clean)))
    assert not any(got[len(clean) + i]["kept"] for i in range(len(bad)))
    assert got[900]["base_failed"] and got[901]["base_failed"] and not got[900]["kept"]


def test_empty(spark):
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_small_groups_are_judged_by_their_language_or_all(spark):
    """A source of few rows in a large language, and a language of few rows: nothing else is small."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    prose = lambda: " ".join(word() for _ in range(r.randint(50, 90))) + "."
    junk = lambda: " ".join(f"{word().upper()}{r.choice('#*$%&|')}{r.choice('#*$%&|')}" for _ in range(60))
    rows = [(k, prose(), "en", "large") for k in range(300)] + [(1000, junk(), "en", "tiny"), (1001, prose(), "en", "tiny"), (1002, junk(), "xx", "tiny"), (1003, prose(), "xx", "tiny")]
    got = {x["doc_id"]: x for x in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("doc_id >= 1000").collect()}
    assert not any(x["base_failed"] or x["distance2"] is None for x in got.values())
    assert {k: x["kept"] for k, x in got.items()} == {1000: False, 1001: True, 1002: False, 1003: True}
