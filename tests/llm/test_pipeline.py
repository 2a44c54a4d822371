import random
from collections import defaultdict

import corpus_pipeline as P


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(0)
    words = [f"{a}{b}{c}" for a in "btkm" for b in "aeiou" for c in "nrls"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    clean = [(i, text(r.randint(40, 120)), "en", f"s{i % 3}", 0) for i in range(300)]
    toxic = [(1000 + i, text(30) + " you vile fool. " + text(30), "en", "s0", 0) for i in range(60)]
    bad = [(2000 + i, text(5) + " ###$$$ &&& ||| " * 20 + text(5), "en", "s1", 0) for i in range(10)]
    copies = [(3000 + i, clean[i][1], "en", "s2", 0) for i in range(20)]
    near = [(4000 + i, clean[50 + i][1] + " extra word", "en", "s2", 0) for i in range(20)]
    rows = clean + toxic + bad + copies + near + [(5000, None, None, None, None), (None, text(50), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, *_ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {x["doc_id"] for x in docs.select("doc_id").collect()}
    ids = lambda rows: {x[0] for x in rows}
    everything = ids(rows)
    assert kept["toxicity"] == everything - ids(toxic)
    assert kept["quality rules"] == kept["toxicity"] - ids(bad) - {5000}
    by_text = defaultdict(list)
    for i, t, *_ in rows:
        if i in kept["quality rules"] and i is not None:
            by_text[t].append(i)
    assert kept["exact dedup"] - {None} == {max(g) for g in by_text.values()}
    assert kept["near dedup"] == kept["exact dedup"] - ids(near)

    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == kept["near dedup"]
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    assert sum(s != 4096 and s & (s - 1) != 0 for s in sizes.values()) == 0


def test_documents_that_are_not_dropped_do_not_move(spark):
    rows = [(i, f"text {i}", "x") for i in range(400)] + [(None, "a", "x"), (None, "b", "x"), (5, "other", "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    key = P.F.sha2(P.text_or_empty().cast("binary"), 256)
    gone = [(3, "text 3"), (None, "a"), (5, "text 5"), (7, "text 8"), (6, None)]
    dropped = spark.createDataFrame(gone, "doc_id long, text string").select("doc_id", key.alias("key"))
    left = P._without(docs, dropped, key)
    assert left.columns == docs.columns
    assert {tuple(r) for r in left.collect()} == {r for r in rows if r[:2] not in gone}
    assert "Union" in left._jdf.queryExecution().toString()
