"""Merkle manifest against a plain tree, and its defined cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as mk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    """Root, and for each node the way up: (position in its run, run) per level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
        for w, k in zip(ways, at):
            w.append((k % 2, runs[k // 2]))
        nodes, at = [H(*x) for x in runs], [k // 2 for k in at]
    return nodes[0], ways


def plain(rows):
    key = lambda v: (v is not None, (v or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order, subs, out = sorted(groups, key=key), {}, []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = grown([leaf(r) for r in groups[g]])
    root, above = grown([subs[g][0] for g in order])
    for g, up in zip(order, above):
        for r, own in zip(groups[g], subs[g][1]):
            found = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                found[3] += 1
            x = leaf(found)
            for k, run in own + up:
                x = H(*(x if j == k else y for j, y in enumerate(run)))
            proof = H(*(y for k, run in own + up for j, y in enumerate(run) if j != k))
            out.append((r[0], leaf(r), subs[g][0], root, proof, x, x == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in mk.op13_merkle(spark, path).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (3, 1, 7), (5, 8, 13, 1, 2)])
def test_small_trees(spark, tmp_path, sizes):
    rows = [(100 * g + k, "s", f"l{g}", k, f"text {k}") for g, n in enumerate(sizes) for k in range(n)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_trees_of_several_rounds(spark, tmp_path):
    """More leaves than a block holds, in one group; and many groups, so that the upper tree has two rounds too."""
    n = (1 << mk.HEIGHT) * 2 + 5
    rows = [(k, "s", "en" if k < n else f"l{k}", k, f"t{k}") for k in range(n + 1030)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_nulls_repeated_rows_empty_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "s", None, None, ""), (7, "é", "en", 3, "日本"), (7, "a", "en", 3, "x"), (8, "b", "", 2, "y" * 300_000), (8, "b", "", 2, "y" * 300_000), (9, "-", "-", 0, "-"), (10, "s", "é", 1, "z"), (11, "s", "z", 1, "z")]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    rows = [(k, "s", "en", k, "t") for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "index", "digest", "id", "found", "size", "rank", "_part")})
    assert {(r.id, r.leaf, r.root) for r in mk.merkle_manifest(docs).collect()} == {(x[0], x[1], x[3]) for x in plain(rows)}


def test_partial_blocks_in_any_order():
    """Digests come in any order and from any partial block; what resolves is no longer held."""
    r = random.Random(5)
    for n in (2, 3, 7, 37, 1 << mk.HEIGHT):
        nodes = [H(str(k)) for k in range(n)]
        parts = [mk.Partial(n) for _ in range(3)]
        for k in r.sample(range(n), n):
            r.choice(parts).put(0, k, nodes[k])
        assert parts[0].merge(parts[1]).merge(parts[2]).top() == grown(nodes)[0]
        assert len(parts[0].nodes) == 1
    with pytest.raises(ValueError):
        mk.Partial(3).put(0, 0, "x").top()


def test_an_altered_leaf_or_sibling_is_noticed(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(6)]
    for x in mk.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert mk.fold(x.leaf, x.way) == x.root == x.folded_root
        assert mk.fold(H("other"), x.way) != x.root
        assert mk.fold(x.leaf, [y[:1] + H("other") if y else y for y in x.way]) != x.root


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in mk.op13_merkle(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain(docs) and {x[6] for x in got} == {True, False}
