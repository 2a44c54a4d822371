"""Line dedup by sorted runs against plain Python, and its defined cases."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as ld

SCHEMA = "doc_id long, text string"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(ld.UPPER, ld.LOWER))


def plain(rows, min_docs, min_chars=1):
    """Sorted (doc_id, n_lines, n_dropped, kept text)."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, lines in split for k in {key(x) for x in lines})
    gone = lambda x: len(key(x)) >= max(1, min_chars) and n[key(x)] >= min_docs
    return sorted(((i, len(x), sum(map(gone, x)), "\n".join(y for y in x if not gone(y))) for i, x in split), key=repr)


def run(spark, rows, min_docs, **more):
    return sorted(map(tuple, ld.line_dedup(spark.createDataFrame(rows, SCHEMA), min_docs=min_docs, **more).collect()), key=repr)


def test_random_texts(spark):
    r = random.Random(3)
    pool = [f"line {k}" for k in range(30)] + ["", " ", "LINE 3", "\tline 4 \r", "É", "é"]
    rows = [(k, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own {k} {r.random()}" for _ in range(r.randint(1, 9)))) for k in range(60)]
    for min_docs in (2, 10):
        assert run(spark, rows, min_docs) == plain(rows, min_docs)


def test_nulls_blanks_ties_repeated_rows_and_long_texts(spark):
    long = "\n".join(["shared"] + [f"l{k}" for k in range(20_000)] + ["Shared "])
    rows = [(1, None), (2, ""), (None, "shared\nx"), (None, "shared\nx"), (3, "shared"), (3, "shared"), (4, "shared\n\nshared"), (5, long), (6, "\n\n")]
    for min_docs in (6, 7, 2):
        assert run(spark, rows, min_docs, batches=3, fanout=2) == plain(rows, min_docs)
    assert run(spark, rows, 2, min_chars=7) == plain(rows, 2, 7)


def test_exactly_enough_documents(spark):
    rows = [(k, "twelve\nnine" if k < 9 else "twelve" if k < 12 else "other") for k in range(14)]
    assert {x[2] for x in run(spark, rows, 10) if x[0] < 12} == {1}
    assert {x[2] for x in run(spark, rows, 9) if x[0] < 9} == {2}


def test_more_frequent_keys_than_are_listed(spark):
    rows = [(k, "\n".join(f"line {j}" for j in range(12) if (k + j) % 3)) for k in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    frequent = ld.index_lines(docs, min_docs=5).frequent()
    got = sorted((tuple(x) for x in ld.drop_lines(docs, frequent, listed=3).collect()), key=repr)
    assert got == plain(rows, 5)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], 2) == []
    rows = [(1, "a\nb", 5, 6), (2, "a", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, h long").withColumns({"g": F.lit(1), "n": F.lit(2), "gone": F.lit(None), "key": F.lit("k"), "pos": F.lit(3)})
    assert sorted(map(tuple, ld.line_dedup(docs, min_docs=2).collect())) == plain([x[:2] for x in rows], 2)


def test_levels_settled_keys_and_reloading(spark, tmp_path):
    """Runs are merged level by level; a settled key enters no later run; a saved index goes on; unseen keys."""
    keys = lambda *lines: ld.document_keys(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], SCHEMA))
    runs = ld.LineRuns(spark, min_docs=3, fanout=2, folder=f"file://{tmp_path}", buckets=4)
    runs.add(keys("a", "a", "a", "b"))
    runs.add(keys("a", "b", "c"))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(keys("a", "b", "d"))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted(n for (n,) in spark.table(runs.levels[0][0]).select("n").collect()) == [1, 1]  # a stays out
    again = ld.LineRuns.load(spark, runs.save())
    again.add(keys("c", "c"))
    assert [len(x) for x in again.levels] == [0, 0, 1]
    assert again.frequent().count() == 3
    assert again.unseen(keys("a", "new")).count() == 1
    with pytest.raises(ValueError):
        ld.LineRuns(spark, fanout=1)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(docs, 10))
    assert sorted(map(tuple, ld.op11_line_dedup(spark, "/root/testdata/sf0.001").collect())) == want
