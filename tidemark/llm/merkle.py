"""Merkle manifest of a dataset: leaf digests per row, a tree per group, a tree over the groups, and proofs.

Combining is driven by events, as in combineByKey: a block of 2^HEIGHT neighbouring nodes is a key; a
partial block takes indexed digests in, in any order and from any task; as soon as a parent has as many
children as the size of its level grants it (two, or one at an odd end), it becomes a node itself and is
handed to its own parent, up to the block's top. Tasks combine what they hold before the shuffle, and only
unresolved nodes travel: a finished subtree is one digest. Block tops are the frontier of the next round,
dealt out anew by wider blocks, until each group has one top left. Rounds number log(rows) / HEIGHT.

Proofs follow the links back: every block knows its children in order, so what lies beside the way from
the top of a tree to a block is passed down round by round, and a leaf's siblings are those inside its
block and then its block's. A block holds at most 2^HEIGHT children, whatever the sizes of groups; a group
with most rows is only more blocks. Texts are hashed where they lie and never travel.

Defined results: nulls are written `-` in a leaf, other fields as byte count, `:`, value; a null group is
a group of its own, before all others; within a group rows go by id, null first, then by leaf digest, so
repeated ids have an order and equal rows have equal proofs up to their places; a group of one row has
its leaf as its root; a single group's root is the dataset's; an empty table gives an empty result;
empty and very long texts are fields like others; columns that are not named as fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ranked, read_table, ship_package
from tidemark.llm.resampling import CRC_MACROS, crc_of

#: A block holds up to 2^HEIGHT nodes of one level.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as `-` if null, else its UTF-8 byte count, `:`, and its value."""
    shown = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Partial:
    """A block under construction: nodes by (level, index), resolved upwards as soon as their arity is met."""

    def __init__(self, size: int):
        self.sizes = [size]  # nodes of the whole tree at each level of this block
        while len(self.sizes) <= HEIGHT and self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // 2))
        self.nodes: dict[tuple[int, int], str] = {}

    def put(self, level: int, index: int, value: str) -> Partial:
        while level + 1 < len(self.sizes):
            first = index & ~1
            wanted = range(first, min(first + 2, self.sizes[level]))
            self.nodes[level, index] = value
            if not all((level, k) in self.nodes for k in wanted):
                return self
            value, level, index = digest([self.nodes.pop((level, k)) for k in wanted]), level + 1, index >> 1
        self.nodes[level, index] = value
        return self

    def merge(self, other: Partial) -> Partial:
        for (level, index), value in other.nodes.items():
            self.put(level, index, value)
        return self

    def top(self) -> str:
        (level, _), value = next(iter(self.nodes.items()))
        if len(self.nodes) > 1 or level + 1 < len(self.sizes):
            raise ValueError("a block lacks nodes")
        return value


def _round(nodes: DataFrame) -> DataFrame:
    """One round: nodes (tree, size, index, digest) to block tops (tree, size, index, digest) of HEIGHT levels up."""
    pairs = nodes.select("tree", "size", "index", "digest").rdd.map(lambda r: ((r[0], r[2] >> HEIGHT), (r[1], r[2], r[3])))
    tops = pairs.combineByKey(
        lambda v: Partial(v[0]).put(0, v[1], v[2]),
        lambda block, v: block.put(0, v[1], v[2]),
        lambda a, b: a.merge(b),
        numPartitions=int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    rows = tops.map(lambda x: (x[0][0], -(-x[1].sizes[0] >> HEIGHT), x[0][1], x[1].top()))
    return nodes.sparkSession.createDataFrame(rows, "tree string, size long, index long, digest string")


def _inside(digests: list[str], first: int, size: int) -> tuple[list[list[str]], int]:
    """Levels of a block from its bottom: lists of digests; and how many levels it has. first: index of its first node."""
    levels, sizes = [digests], Partial(size).sizes
    for _ in sizes[1:]:
        below = levels[-1]
        levels.append([digest(below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels, len(sizes) - 1


def siblings(levels: list[list[str]], height: int, k: int) -> list[str]:
    """What lies beside the way from node k of a block to its top: per level `L` or `R` and the sibling's digest, or nothing."""
    out = []
    for level in levels[:height]:
        other = k ^ 1
        out.append(("L" if k & 1 else "R") + level[other] if other < len(level) else "")
        k >>= 1
    return out


def fold(leaf: str, way: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for beside in way:
        leaf = digest([beside[1:], leaf] if beside[:1] == "L" else [leaf, beside[1:]])
    return leaf


def proof_digest(way: list[str]) -> str:
    return digest(beside[1:] for beside in way)


def _ways_down(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(tree, index, way) of the nodes (tree, size, index, digest) of a round, from (tree, index, way) of the blocks they are in."""
    met = _blocks(nodes, ["digest"]).join(ways.withColumnRenamed("index", "block"), ["tree", "block"])

    def each(batches: Iterator) -> Iterator:
        for rows in _rows(batches):
            for b in rows:
                levels, height = _inside([m["digest"] for m in b["members"]], b["block"] << HEIGHT, b["size"])
                yield from ({"tree": b["tree"], "index": m["index"], "way": siblings(levels, height, k) + b["way"]} for k, m in enumerate(b["members"]))

    return met.mapInArrow(_batched(each, "tree string, index long, way array<string>"), "tree string, index long, way array<string>")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, block, size, members): a block's nodes in order; members are bounded by 2^HEIGHT."""
    member = F.struct("index", *payload)
    return nodes.groupBy("tree", F.shiftright("index", HEIGHT).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("members"))


def _rows(batches: Iterator) -> Iterator[list[dict]]:
    for batch in batches:
        for k in range(batch.num_rows):  # one block at a time in Python objects
            yield batch.slice(k, 1).to_pylist()


def _batched(rows_of, schema: str, at_once: int = 4096):
    """A function of Arrow batches from a generator of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = []
        for row in rows_of(batches):
            held.append(row)
            if len(held) == at_once:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return run


def tree(leaves: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, digest) of leaves (tree, size, index, digest), and the nodes of each round from the leaves up."""
    ship_package(leaves.sparkSession)
    rounds = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 1
    while largest > 1:
        rounds.append(materialize(_round(rounds[-1].where("size > 1")).unionByName(rounds[-1].where("size = 1").select("tree", "size", "index", "digest")), name))
        largest = -(-largest >> HEIGHT)
    return rounds[-1].select("tree", "digest"), rounds


def ways(rounds: list[DataFrame], above: DataFrame, down_to: int = 0) -> DataFrame:
    """(tree, index, way) of the nodes of round down_to; above: (tree, way) of the trees' roots."""
    found = above.select("tree", F.lit(0).cast("long").alias("index"), "way")
    for nodes in reversed(rounds[down_to:-1]):
        found = _ways_down(nodes, found)
    return found


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None, change: Column | None = None) -> DataFrame:
    """One row per document: id, leaf, subroot, root, way (its proof), and folded_root of the row as found.

    tampered: columns that take the place of fields in the row as found, where change holds.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    again = leaf_digest([(tampered or {}).get(c, F.col(c)) for c in fields])
    found = F.when(F.coalesce(change, F.lit(False)), again) if change is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"), leaf.alias("digest"), found.alias("found"))
    placed = ranked(rows, [F.asc("id"), F.asc("digest")], "leaves", "tree").withColumn("index", F.col("rank").cast("long") - 1).drop("rank")
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    leaves = materialize(placed.join(sizes, "tree"), "placed-leaves")

    subroots, rounds = tree(leaves, "nodes")
    tops = ranked(subroots.select(F.lit("").alias("all"), "tree", "digest"), [F.asc("tree")], "subroots", "all")
    tops = materialize(tops.select(F.col("all").alias("tree"), F.col("tree").alias("group"), "digest", (F.col("rank").cast("long") - 1).alias("index")), "subroots")
    n = tops.count()
    tops = tops.withColumn("size", F.lit(n).cast("long"))
    root, top_rounds = tree(tops, "top-nodes")
    spark = docs.sparkSession
    group_ways = ways(top_rounds, spark.createDataFrame([("", [])], "tree string, way array<string>"))
    groups = tops.join(group_ways, ["tree", "index"]).join(root.withColumnRenamed("digest", "root"), "tree")
    groups = materialize(groups.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "way"), "groups")

    if len(rounds) == 1:  # groups of one row only
        met = leaves.join(groups, "tree").withColumns({"block": F.lit(0).cast("long"), "members": F.array(F.struct("index", "digest", "id", "found"))})
    else:
        met = _blocks(leaves, ["digest", "id", "found"]).join(ways(rounds, groups, 1).withColumnRenamed("index", "block"), ["tree", "block"]).join(groups.drop("way"), "tree")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, way array<string>, folded_root string"

    def each(batches: Iterator) -> Iterator:
        for blocks in _rows(batches):
            for b in blocks:
                levels, height = _inside([m["digest"] for m in b["members"]], b["block"] << HEIGHT, b["size"])
                for k, m in enumerate(b["members"]):
                    way = siblings(levels, height, k) + b["way"]
                    yield {"id": m["id"], "leaf": m["digest"], "subroot": b["subroot"], "root": b["root"], "way": way, "folded_root": fold(m["found"] or m["digest"], way)}

    return met.select("tree", "block", "size", "members", "way", "subroot", "root").mapInArrow(_batched(each, schema, 256), schema)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    change = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle_manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, change=change)
    proof = F.sha2(F.array_join(F.transform("way", lambda x: F.substring(x, 2, 64)), "").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, source: str) -> str:
    """Nodes of all trees of source(tree, i, n, d), level by level."""
    return f"""
{name}(tree, level, i, n, d) AS (
  SELECT tree, 0, i, n, d FROM {source}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, i // 2)"""


def _sql_way(name: str, source: str, nodes: str) -> str:
    """The siblings of each row of source, as lists in the order of levels."""
    return f"""
{name} AS (
  SELECT s.tree, s.i, list(CASE WHEN b.d IS NULL THEN '' WHEN (s.i >> l.level) & 1 = 1 THEN 'L' || b.d ELSE 'R' || b.d END ORDER BY l.level) AS way
  FROM {source} s JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) l ON l.tree = s.tree
  LEFT JOIN {nodes} b ON b.tree = s.tree AND b.level = l.level AND b.i = xor(s.i >> l.level, 1) GROUP BY s.tree, s.i)"""


def _sql_leaf(n_chars: str) -> str:
    fields = [c if c != "n_chars" else n_chars for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in fields) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC_MACROS}
l AS (SELECT *, coalesce('=' || lang, '') AS tree, {_sql_leaf('n_chars')} AS d, coalesce({crc_of('doc_id::VARCHAR')} % 7 = 0, false) AS hit, {_sql_leaf('n_chars + 1')} AS d2 FROM documents CROSS JOIN crc_table c),
leaf AS (SELECT tree, doc_id, d, CASE WHEN hit THEN d2 ELSE d END AS found, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_sql_tree('node', 'leaf')},
top AS (SELECT '' AS tree, tree AS g, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM node WHERE n = 1),
{_sql_tree('above', 'top')},
{_sql_way('leaf_way', 'leaf', 'node')},
{_sql_way('top_way', 'top', 'above')},
r AS (
  SELECT leaf.doc_id, leaf.d AS leaf, leaf.found, top.d AS subroot, (SELECT d FROM above WHERE n = 1) AS root, list_concat(coalesce(a.way, []), coalesce(b.way, [])) AS way
  FROM leaf JOIN top ON top.g = leaf.tree LEFT JOIN leaf_way a ON a.tree = leaf.tree AND a.i = leaf.i LEFT JOIN top_way b ON b.i = top.i),
f AS (SELECT *, list_reduce(list_prepend(found, way), lambda x, y: CASE substr(y, 1, 1) WHEN 'L' THEN sha256(substr(y, 2) || x) WHEN 'R' THEN sha256(x || substr(y, 2)) ELSE sha256(x) END) AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(way, lambda x: substr(x, 2)), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
