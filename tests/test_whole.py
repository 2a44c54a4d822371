"""Queries on small tables of rows that a partial job would lose."""

from tidemark.plans import catalog, inventory, inventory_more  # noqa: F401


def answer(spark, path, name, tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
    df = catalog.queries()[name](spark, str(path))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_similar_vectors_with_smaller_ids(spark, tmp_path):
    """Partners of a query on both sides of its id; two queries once; no pair of non-queries or of other labels."""
    rows = [(57, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (130, [1.0, 0.0], 1), (200, [1.0, 0.0], 1), (58, [0.0, 1.0], 1), (59, [1.0, 0.0], 2)]
    got = answer(spark, tmp_path, "jon_44_similar_vectors", {"embeddings": (rows, "vec_id long, embedding array<float>, label int")})
    assert [(a, b) for a, b, _ in got] == [(100, 130), (100, 200), (100, 57), (200, 130), (200, 57)]


def test_union_of_ports_by_whole_name(spark, tmp_path):
    """Names that share four last characters stay apart; better rank, then v1, then the smaller key; seeds fill gaps only."""
    tables = {
        "customer": ([("Customer#000000001", 1, 5.0), ("Customer#000010001", 10001, 9.0), ("Customer#000000002", 2, -5.0), ("Customer#000000003", 3, 7.0), (None, 4, 1.0)], "c_name string, c_custkey long, c_acctbal double"),
        "supplier": ([("Supplier#000000002", 2, 1.0), ("Supplier#000000003", 3, 7.0), ("Supplier#", 5, 1.0), ("Supplier#000000006", 6, None)], "s_name string, s_suppkey long, s_acctbal double"),
        "part": ([(1, 900.0), (8, 901.0), (12345678901, 902.0)], "p_partkey long, p_retailprice double"),
    }
    assert answer(spark, tmp_path, "jon_39_union_ports", tables) == [
        ("000000001", "v1", 1, 5.0),
        ("000000002", "run", 2, 1.0),
        ("000000003", "v1", 3, 7.0),
        ("000000006", "run", 6, 0.0),
        ("000000008", "seed", 8, 901.0),
        ("000010001", "v1", 10001, 9.0),
        ("12345678901", "seed", 12345678901, 902.0),
    ]


def test_review_report_of_three_tables(spark, tmp_path):
    """Odd ids, ids of one table alone, the last comment that is not blank, actions of comments and choices, summary."""
    tables = {
        "conversations": ([(1, 2, "see HTTP://a.b/c). and http://a.b/c, HTTP://a.b/c"), (1, 1, "old"), (1, 3, " \n\t"), (5, 1, "only a comment"), (8, 1, " ")], "conv_id long, turn long, text string"),
        "labels": ([(1, 1, 0), (7, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int"),
        "documents": ([(1, "en", 1500), (3, "fr", 20)], "doc_id long, lang string, n_chars long"),
    }
    got = answer(spark, tmp_path, "agg_15_review_report", tables)
    n = None
    assert {x[1:9] for x in got if x[0] == "item"} == {
        ("project", 1, "see HTTP://a.b/c). and http://a.b/c, HTTP://a.b/c", 2, 1, 0, "en", True),
        ("capitainerie", 3, n, n, n, n, "fr", False),
        ("eez", 5, "only a comment", 1, n, n, n, False),
        ("marina", 7, n, n, 0, 1, n, False),
    }
    assert sorted((x[2], *x[9:11]) for x in got if x[0] == "action") == [
        (1, "suggested_urls", "HTTP://a.b/c"),
        (1, "suggested_urls", "http://a.b/c"),
        (1, "td_kept", "HTTP://a.b/c"),
        (1, "td_kept", "http://a.b/c"),
        (1, "td_kept", "quality"),
        (1, "td_kept", "toxic"),
        (7, "td_dropped", "quality"),
        (7, "td_dropped", "toxic"),
    ]
    assert sorted((x[1], *x[11:]) for x in got if x[0] == "summary") == [("capitainerie", 1, 0, 0), ("eez", 1, 1, 0), ("marina", 1, 0, 0), ("project", 1, 1, 1)]


def test_names_of_whole_texts(spark, tmp_path):
    """Texts whose first 60 characters hold fewer usable ones than the cap, or none."""
    rows = [(1, "#" * 70 + "Évian Port 12"), (2, "a " * 50), (3, "αβγ " * 20 + "Harbour of the long name, and of more than forty letters")]
    for name, wanted in (("str_01_name_key", ["evianport12", "a" * 40, "harbourofthelongnameandofmorethanfortyletters"[:40]]), ("str_02_spaced_name", ["evian port 12", ("a " * 13)[:25], "harbour of the long name "])):
        got = answer(spark, tmp_path / name, name, {"documents": (rows, "doc_id long, text string")})
        assert got == list(zip((1, 2, 3), wanted))
