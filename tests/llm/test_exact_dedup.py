import hashlib

from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = set()
    for i, t in rows:
        g = groups[t or ""]
        best = max((x for x in g if x is not None), default=None)
        out.add((i, best, len(g), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


ROWS = [(1, "a"), (2, "a "), (3, "a"), (4, None), (5, ""), (6, "é"), (7, "é"), (8, "x" * 100_000), (9, "x" * 100_000), (10, "A"), (None, "a"), (12, "b"), (12, "b")] + [(100 + i, "hot") for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep_id": F.lit("clash"), "digest": F.lit(0)})


def test_groups(spark):
    got = {tuple(r) for r in exact_dedup(frame(spark, ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute(ROWS)


def test_clashing_digests_are_resolved_by_text(spark):
    got = exact_dedup(frame(spark, ROWS), digest=lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(3)))
    assert {tuple(r) for r in got.collect()} == brute(ROWS)
    assert got.count() == len(ROWS)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_texts_that_occur_once_do_not_move(spark):
    rows = [(i, f"only {i}") for i in range(500)] + [(1000 + i, "twice") for i in range(2)] + [(None, "null id"), (7, "only 8")]
    df = frame(spark, rows).repartition(3)
    out = exact_dedup(df)
    assert {tuple(r) for r in out.collect()} == brute(rows)
    assert {r["doc_id"]: r["group_size"] for r in out.collect()}[8] == 2 and out.count() == len(rows)
    plan = out._jdf.queryExecution().toString()
    assert "Union" in plan and "ask(" in plan
