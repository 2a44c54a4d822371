import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import minhash as M
from tidemark.llm.components import components


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=0):
    r = random.Random(seed)
    words = ["the", "of", "sea"] + [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]

    def edited(base, share):
        return [w if r.random() > share else r.choice(words) for w in base]

    out = []
    for size in (5, 9, 30, 70, 300):
        for _ in range(4):
            base = text(size)
            out += [base, base] + [edited(base, share) for share in (0.02, 0.05, 0.08, 0.1, 0.12)]
    star = text(120)
    out += [star] + [edited(star, 0.09) for _ in range(60)]
    passage = text(60)
    out += [text(r.randint(20, 60)) + passage + text(r.randint(20, 60)) for _ in range(60)]
    chain = text(200)
    for _ in range(30):
        chain = edited(chain, 0.04)
        out.append(list(chain))
    out += [["the"], ["the"], ["of", "the"], ["of", "the", "sea"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    r.shuffle(rows)
    return rows + [(5000, None), (5001, " \n"), (5002, "The"), (None, "the sea"), (None, None)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_shingles": F.lit("x"), "cid": F.lit(0)}).repartition(4)
    for n in (2, 5):
        want = brute(rows, n)
        got = M.near_duplicates(df, n=n).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
        assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_long_lists_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(M, "SHORT_LIST", 3)
    monkeypatch.setattr(M, "BLOCK", 4)
    monkeypatch.setattr("tidemark.llm.common.SALT_ROWS", 4)
    rows = corpus(1)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == brute(rows, 2)


def test_estimate():
    r = np.random.default_rng(0)
    big = [np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64)) for _ in range(3)]
    a, b = np.sort(np.concatenate([big[0][::2], big[1][:100]])), big[0]
    pad = lambda x: np.concatenate([x[: M.K], np.full(max(0, M.K - len(x)), np.iinfo(np.uint64).max, np.uint64)])[None]
    j, used = M.union_estimate(pad(a), pad(b), np.array([len(a)]), np.array([len(b)]))
    union = np.union1d(a, b)[: M.K]
    assert j[0] == np.mean(np.isin(union, a) & np.isin(union, b)) and used[0] == M.K
    j, used = M.union_estimate(pad(a[:10]), pad(a[5:20]), np.array([10]), np.array([15]))
    assert j[0] == 5 / 20 and used[0] > 1000


def test_least_overlap():
    """No two nested sets of similarity 0.8 share fewer retained values than lists ask for, where that is certain."""
    r = np.random.default_rng(1)
    for size in range(1, 100):
        for other in {size, size + 1, int(size / 0.8)}:
            if size < 0.8 * other - 1e-9:
                continue
            b = r.permutation(other)
            for a in (b[:size], np.sort(b)[:size], np.sort(b)[other - size :]):
                both = len(np.intersect1d(np.sort(a)[: M.K], np.sort(b)[: M.K]))
                assert both >= M.least_overlap(np.array([size, other]), 0.8).max()


def test_shingles_of_slices():
    texts = ["a b c a b", None, "x", "A B", "é  É"]
    for at in (0, 2):
        o, s = M.shingle_sets(pa.array(texts, pa.string()).slice(at), 2)
        assert np.diff(o).tolist() == [len(shingles(t, 2)) for t in texts[at:]]


def test_signatures():
    """Bits differ as often as the similarity says, for sets of any size; the bound leaves out one pair in 1 / MISS."""
    r = np.random.default_rng(2)
    for size in (9, 900):
        pool = r.integers(0, 1 << 63, (400, size)).astype(np.uint64) * np.uint64(2)
        sets = np.concatenate([pool[:, : size * 8 // 9], pool[:, size // 9 :]])
        sig = M.signatures(np.arange(801) * (size * 8 // 9), sets.ravel(), 4)
        unlike = np.bitwise_count(sig[:400] ^ sig[400:]).sum(1)
        assert abs(unlike.mean() / 256 - 1 / 9) < 0.01 and unlike.max() <= M.most_unlike(256, 7 / 9)
        assert np.bitwise_count(sig[:400] ^ np.roll(sig[:400], 1, 0)).sum(1).min() > M.most_unlike(256, 0.8)
    assert not M.signatures(np.array([0, 0, 3, 3]), np.arange(3, dtype=np.uint64), 1)[[0, 2]].any()
    assert M.most_unlike(64, 1.0) == 0 and M.most_unlike(64, 0.8) < M.most_unlike(64, 0.5) < 64


def test_rows_of_a_large_near_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Near copies whose base is gone: many are linked with none, and still only few pairs become rows."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [r.choice(words) for _ in range(150)]
    share = [0.01, 0.03, 0.06, 0.09]
    rows = [(i, " ".join(w if r.random() > share[i % 4] else r.choice(words) for w in base)) for i in range(400)]
    steps, rows_of = [], {}
    monkeypatch.setattr(M, "materialize", lambda df, name, *a, keep=M.materialize: steps.append((name, keep(df, name, *a))) or steps[-1][1])
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=2).collect()
    assert {x["doc_id"]: tuple(x)[1:] for x in got} == brute(rows, 2)
    for name, table in steps:
        rows_of[name] = max(rows_of.get(name, 0), table.count())
    assert 20 < sum(x["kept"] for x in got) < 380 and rows_of["group-sets"] > 100
    assert all(rows_of.get(name, 0) < 24 * len(rows) for name in ("pairs", "promising", "rest-pairs", "rest-near", "group-links"))
    assert "rest-pairs" not in rows_of and rows_of["group-links"] < len(rows)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, 501 + k) for k in range(50)]
    got = {x["a"]: x["b"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {i: find(i) for i in list(root) if find(i) != i}


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
