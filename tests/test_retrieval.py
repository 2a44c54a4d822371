"""Chunks and TF-IDF cosines against dense plain vectors."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import retrieval as rt


def plain_terms(t):
    w = re.findall(r"(?u)\b\w\w+\b", (t or "").lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def plain_scores(query, docs):
    every = [plain_terms(x) for x in [query, *docs]]
    df = Counter(k for c in every for k in c)
    vec = [{k: n * (math.log((1 + len(every)) / (1 + df[k])) + 1) for k, n in c.items()} for c in every]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    return [sum(v * vec[0].get(k, 0) for k, v in x.items()) / (n * norm[0]) if n and norm[0] else 0.0 for x, n in zip(vec[1:], norm[1:])]


def text(r, n):
    return " ".join(r.choice(["Port", "of", "entry", "a", "été", "x1", "customs.", "list,", "Marina"]) for _ in range(n))


def test_scores_and_top_chunks(spark):
    r = random.Random(1)
    texts = {k: [text(r, r.randint(0, 15)) for _ in range(r.randint(1, 12))] for k in range(12)}
    queries = {k: text(r, 5) if k else "" for k in range(11)}
    pieces = spark.createDataFrame([(k, p, t) for k, ts in texts.items() for p, t in enumerate(ts)], "doc int, pos long, text string")
    asked = spark.createDataFrame(list(queries.items()), "doc int, text string")
    scores = rt.chunk_scores(pieces, asked).cache()
    got = {(x.doc, x.pos): x.score for x in scores.collect()}
    for k, ts in texts.items():
        want = plain_scores(queries.get(k, ""), ts)
        assert all(abs(got[k, p] - w) < 1e-9 for p, w in enumerate(want))
    top = {}
    for x in rt.top_chunks(pieces, scores, 3).orderBy("doc", "pos").collect():
        top.setdefault(x.doc, []).append(x.pos)
    for k, ts in texts.items():
        want = [round(s, 12) for s in plain_scores(queries.get(k, ""), ts)]
        assert top[k] == sorted(sorted(range(len(ts)), key=lambda p: (-want[p], p))[:3])


def test_chunks_cover_the_text(spark):
    r = random.Random(2)
    texts = [None, "", "  ", "short text", "x" * 1300, " ".join(f"w{k}" for k in range(900)), "\n".join(f"{text(r, 40)} {k}. " for k in range(30)), " ".join(f"ab{k}" for k in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for size, overlap in ((500, 60), (80, 0), (50, 49)):
        for x in df.select("t", rt.chunks(F.col("t"), size, overlap).alias("c")).collect():
            flat = re.sub(r"\s+", " ", x.t or "").strip()
            assert all(0 < len(c) <= size for c in x.c) and (len(flat) > size or x.c == ([flat] if flat else []))
            at = 0
            for c in x.c:  # each piece lies in the text, after the one before, with nothing but space between
                p = flat.find(c, max(0, at - overlap - 1) if "x" not in c[:2] else max(0, at - overlap))
                assert p >= 0 and not flat[at:p].strip()
                at = max(at, p + len(c))
            assert not flat[at:].strip()


def test_versions_of_a_text(spark):
    long = " ".join(f"word{k}" for k in range(200))
    rows = [(1, "same text", "same text"), (2, None, "x y"), (3, "", ""), (4, long, long + " more"), (5, "port list", "other things"), (6, "!!", "??")]
    df = spark.createDataFrame(rows, "doc int, a string, b string")
    got = dict(map(tuple, rt.pair_similarity(df).collect()))
    assert (got[1], got[2], got[3], got[5], got[6]) == (1.0, 0.0, 0.0, 0.0, 0.0) and abs(got[4] - plain_scores(long, [long + " more"])[0]) < 1e-9
    assert dict(map(tuple, rt.content_changed(df).collect())) == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_texts_are_scored_where_they_lie(spark, tmp_path):
    """No shuffle of words, pieces or texts, and the same rows as from tables of pieces and queries."""
    from tidemark.plans import inventory_retrieval as plans

    r = random.Random(3)
    docs = [(k, None if k == 7 else text(r, r.choice([0, 3, 400, 3000]))) for k in range(60)]
    items = [(k, text(r, 6)) for k in range(38)]  # documents 38, 39 have none
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    p = plans.pieces(spark, str(tmp_path)).cache()
    asked = spark.createDataFrame([(k, dict(items)[k % 40]) for k, _ in docs if k % 40 < 38], "doc long, text string")
    found = rt.chunk_scores(p, asked).cache()
    score = plans.str_31(spark, str(tmp_path))
    top = plans.srt_09(spark, str(tmp_path))
    changed = plans.str_33(spark, str(tmp_path))
    assert sorted(map(tuple, score.collect())) == sorted((x.doc, x.pos, round(x.score, 9)) for x in found.collect())
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, rt.top_chunks(p, found).select("doc", "pos", "text", "rank").collect()))
    assert {x.doc for x in changed.collect()} == set(range(60))
    for df in (score, top, changed):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
