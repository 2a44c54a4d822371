"""MinHash near-deduplication with bottom-k sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct word shingles; its sketch is the K
   smallest. Documents with equal sets form one class and are linked without pairs.
2. Inverted lists of retained values: two sets of the similarity asked for share at least `t` of
   their retained values, so if all classes order theirs alike, rarest first, both hold a shared one
   among their first K - t + 1. Only these are listed; common shingles are in nobody's list. The order
   comes from counts of all retained values in at most MAX_CELLS cells, 1 byte each: a bounded
   broadcast at any size, and values that share a cell only make lists longer. For sets that their sketch holds whole, and
   for somewhat larger ones, t is certain; for others fewer than t values are shared by a pair just
   at the bound in one case in 10^7.
3. Lists of up to SHORT_LIST classes give all pairs. Longer ones, which near copies fill, link each
   class to the one with the fewest values of its own. Only pairs whose signatures of 64 min-wise bits
   are near enough become rows (a pair just at the bound is lost in one case in 10^7).
4. Pairs are filtered by the union-sketch estimate (4.5 standard errors: a pair just at the bound is
   lost in one case in 10^5), and what remains is verified by the exact Jaccard similarity of the
   full sets, built again from the texts.
5. Long lists whose classes lie in one component by now are done. The classes of those that still span
   components are listed once more, by their full sets: there the prefixes are as short as the
   similarity allows, and a pair is dropped where the values after the shared one cannot suffice or
   signatures of 256 bits differ too much (one case in 10^7). What remains joins classes to groups, and
   each two blocks of a group meet with their full sets. Both steps return only the links that join what
   all links would join. So no list is cut, and groups of copies never become all their pairs.
6. Connected components over the links between classes name the groups.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; rows with a null id are linked with nothing and have a
null component; of rows that repeat an id each is in the component of its own text, and classes with
the same smallest id are one; very long texts are one set each, about as large as the text; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import materialize, read_table, salted_join, ship_package
from tidemark.llm.components import components
from tidemark.llm.key_filter import key_filter, may_hold

K = 64
#: Values are counted in about as many cells as there are values, 1 byte each, at most MAX_CELLS.
MAX_CELLS, SHARDS = 1 << 25, 64
#: Chance that a pair just at the similarity shares fewer retained values than lists ask for.
MISS = 1e-7
#: Lists up to this length give all pairs at once.
SHORT_LIST = 40
#: Members of a block when the rest of a long list is compared, words of their signatures, and bytes of full sets in a block of a group.
BLOCK, REST_WORDS, GROUP_BYTES = 1024, 4, 1 << 18
#: Keys with at least this share of all rows are broadcast: there are at most MAX_HOT of them.
MAX_HOT = 1 << 16
SLICE_BYTES = 2 << 20


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text, and the sorted distinct shingle hashes of each text, one after the other."""
    offsets, words = B.word_lists(texts)
    codes, distinct = B.distinct_words(words)
    h = B.hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(h))  # words from here to the end of the text
    shingle, first = h.copy(), np.arange(len(h)) == np.repeat(offsets[:-1], lengths)
    for k in range(1, n):
        more = left > k
        at = np.flatnonzero(more)
        shingle[at] = B.mix(shingle[at], h[at + k])
    use = (left >= n) | first  # a text with fewer words is one shingle
    doc, shingle = doc[use], shingle[use]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    doc, shingle = doc[new], shingle[new]
    return np.searchsorted(doc, np.arange(len(lengths) + 1)), shingle


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches (id, text) of bounded text size."""
    for b in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
            yield b.slice(at, upto - at)
            at = upto


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, sketch, sig) of docs (doc_id, text, text_hash)."""

    def run(batches):
        for b in _slices(batches):
            offsets, s = shingle_sets(b.column(1), n)
            raw, cuts = s.tobytes(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            ids = [hashlib.blake2b(raw[8 * a : 8 * e], digest_size=16).digest() for a, e in cuts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(ids, pa.binary()), pa.array([raw[8 * a : 8 * min(e, a + K)] for a, e in cuts], pa.binary()), pa.array(signatures(offsets, s, 1)[:, 0].view(np.int64))],
                ["doc_id", "text_hash", "n_shingles", "set_id", "sketch", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, sketch binary, sig long")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values per row, and all values, of packed sets or sketches."""
    raw = [x.as_buffer() for x in column]
    return np.array([len(x) // 8 for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint64)


def rarity(sets: DataFrame, values: int) -> np.ndarray:
    """Size class of the count of each cell, over all values of sets (data), of which there are so many."""
    cells = min(MAX_CELLS, max(SHARDS << 10, 1 << max(values - 1, 1).bit_length()))
    width = cells // SHARDS

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for b in batches:
            held, n = np.unique(_values(b.column(0))[1] & np.uint64(cells - 1), return_counts=True)
            total[held] += n.astype(np.uint32)
        for k in range(SHARDS):
            part = total[k * width : (k + 1) * width]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([B.pack_ints(np.diff(at, prepend=0).astype(np.uint32))], pa.binary()), pa.array([B.pack_ints(part[at])], pa.binary())], ["shard", "at", "n"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for at, n in zip(rows.column("at"), rows.column("n")):
            total[np.cumsum(B.unpack_ints(at.as_py(), np.uint32), dtype=np.int64)] += B.unpack_ints(n.as_py(), np.uint32)
        size = np.minimum(np.round(6 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "size": pa.array([size.tobytes()], pa.binary())})

    found = sets.mapInArrow(count, "shard int, at binary, n binary").groupBy("shard").applyInArrow(add, "shard int, size binary").collect()
    out = np.zeros(cells, np.uint8)
    for shard, size in found:
        out[shard * width : (shard + 1) * width] = np.frombuffer(bytes(size), np.uint8)
    return out


def signatures(offsets: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits of each set: a bit of its least value under as many hash functions. A pair has each bit alike with chance (1 + similarity) / 2."""
    out, full = np.zeros((len(offsets) - 1, words), np.uint64), np.flatnonzero(np.diff(offsets))
    odd = B.mix(np.arange(1, 64 * words + 1), 77) | np.uint64(1)
    for f in range(64 * words if len(full) else 0):
        least = np.minimum.reduceat(values * odd[f], offsets[:-1][full])
        out[full, f // 64] |= (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)) << np.uint64(f % 64)
    return out


def most_unlike(bits: int, similarity: float) -> int:
    """Bits of a signature in which a pair of the similarity asked for differs at most, but for a chance of MISS."""
    share, tail, most = (1 - similarity) / 2, 0.0, bits
    while most and (tail := tail + math.comb(bits, most) * share**most * (1 - share) ** (bits - most)) <= MISS:
        most -= 1
    return most


def least_overlap(sizes: np.ndarray, similarity: float, k: int = K) -> np.ndarray:
    """Retained values that a set of each size shares at least with any set of the similarity asked for."""
    tail, likely = 0.0, 0
    while tail <= MISS and likely <= k:
        tail += math.comb(k, likely) * similarity**likely * (1 - similarity) ** (k - likely)
        likely += 1
    certain = k - np.floor(sizes * (1 - similarity) / similarity + 1e-9)
    whole = np.ceil(similarity * sizes - 1e-9)
    # the union holds up to k values, all of them retained, or more, of which the k smallest are
    return np.where(sizes <= k, np.minimum(whole, certain), np.maximum(certain, likely - 1)).astype(np.int64)


def _postings(sets: DataFrame, order, similarity: float, whole: bool) -> DataFrame:
    """(key, cid, n, own, place, sig) of the rarest values of sets (cid, n, data, sig): as many as a shared one is certainly among.

    own: share of values that no other set seems to hold; place: values before this one. whole: data holds full sets, not sketches; then sig is not read but made, of REST_WORDS words.
    """

    def run(batches):
        for b in batches:
            ids, sizes = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)
            held, values = _values(b.column(2))
            sig = pa.array([x.tobytes() for x in signatures(np.concatenate([[0], np.cumsum(held)]), values, REST_WORDS)], pa.binary()) if whole else b.column(3)
            owner = np.repeat(np.arange(len(held)), held)
            size = order.value[values & np.uint64(len(order.value) - 1)]
            at = np.lexsort((values, size, owner))
            values, owner, size = values[at], owner[at], size[at]
            place = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)
            least = np.ceil(similarity * sizes - 1e-9).astype(np.int64) if whole else least_overlap(sizes, similarity)
            own = np.bincount(owner, size == 0, len(held)) / np.maximum(held, 1)
            keep = (place < (held - least + 1)[owner]) & (size > 0)  # a value alone in its cell is in no other set
            o = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[keep].view(np.int64)), pa.array(ids[o], pa.int64()), pa.array(sizes[o]), pa.array(own[o]), pa.array(place[keep], pa.int64()), sig.take(pa.array(o))],
                ["key", "cid", "n", "own", "place", "sig"],
            )

    return sets.select("cid", "n", "data", *["sig"] * (not whole)).mapInArrow(run, "key long, cid long, n long, own double, place long, sig " + ("binary" if whole else "long"))


def _with_lists(rows: DataFrame, lists: DataFrame, total: int) -> DataFrame:
    """rows joined with lists (key, members, ...) by key. The few keys that hold a large share of all rows are not shuffled."""
    floor = max(SHORT_LIST, total // MAX_HOT)
    hot = F.broadcast(lists.where(F.col("members") > floor))  # at most total / floor rows
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(lists.where(F.col("members") <= floor), "key"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of K values; what is missing is the largest value."""
    out = np.full((len(column), K), np.iinfo(np.uint64).max, np.uint64)
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), np.uint64)
        out[k, : len(v)] = v
    return out


def union_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity from the smallest values of the union, as many as a sketch holds, and how many values it rests on (all: exact)."""
    top, width = np.iinfo(np.uint64).max, a.shape[1]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    rank = np.cumsum(~twice, axis=1)
    whole = (na <= width) & (nb <= width)
    limit = np.where(whole, 2 * width, width)[:, None]
    real = both != top
    shared = (twice & (rank <= limit)).sum(1)
    used = (~twice & real & (rank <= limit)).sum(1)
    return shared / np.maximum(used, 1), np.where(whole, 1 << 30, used)


def _passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the estimate is no more than 4.5 standard errors below the similarity asked for."""
    j, used = union_estimate(a, b, na, nb)
    return j >= similarity - 1e-9 - np.where(used >= 1 << 30, 0.0, 4.5 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1)))


def _promising(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that the union-sketch estimate lets pass."""
    asked = key_filter(pairs.select(F.explode(F.array("a", "b")).alias("cid")))

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(may_hold(asked, np.asarray(b.column(0)))))

    c = materialize(classes.select("cid", "n", "data").mapInArrow(pick, "cid long, n long, data binary"), "asked", "none")
    met = salted_join(pairs.select("a", "b"), c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("data").alias("sb")), "b", "a")
    met = salted_join(met, c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("data").alias("sa")), "a", "b", counted=pairs)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = b.slice(at, 4096)
                keep = pa.array(_passes(_matrix(x.column(4)), _matrix(x.column(5)), np.asarray(x.column(2)), np.asarray(x.column(3)), similarity))
                yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], ["a", "b"])

    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, n, data): full sets of classes (cid, text_hash), built from the texts of docs (doc_id, text, text_hash).

    Texts stay where they lie: sets are built of those that the filter cannot rule out, and these meet the classes.
    """
    asked = key_filter(classes.select("cid"))

    def build(batches):
        for b in _slices(batches):
            b = b.filter(pa.array(may_hold(asked, np.asarray(b.column(0)))))
            offsets, s = shingle_sets(b.column(1), n)
            raw, cuts = s.tobytes(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            sets = pa.array([raw[8 * a : 8 * e] for a, e in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(offsets), pa.int64()), sets], ["cid", "text_hash", "n", "data"])

    built = docs.select(F.col("doc_id").alias("cid"), "text", "text_hash").mapInArrow(build, "cid long, text_hash long, n long, data binary")
    return built.join(classes.hint("merge"), ["cid", "text_hash"], "left_semi").dropDuplicates(["cid", "text_hash"]).drop("text_hash")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    met = salted_join(pairs, sets.select(F.col("cid").alias("b"), F.col("data").alias("sb")), "b", "a")
    met = salted_join(met, sets.select(F.col("cid").alias("a"), F.col("data").alias("sa")), "a", "b", counted=pairs)

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return materialize(met.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"), "links")


def _spanning(left: np.ndarray, right: np.ndarray, label: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows left and right, as few as join what all links would join. label: group of each row; linked(x): which of right row x links to."""
    out = []
    for x in left:
        open_ = label[right] != label[x]
        if open_.any():
            y = right[linked(x) & open_]
            found, first = np.unique(label[y], return_index=True)
            out += [(x, k) for k in y[first]]
            label[np.isin(label, found)] = label[x]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _ordered(cid: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(cid[x], cid[y]), pa.int64()), pa.array(np.maximum(cid[x], cid[y]), pa.int64())]


def _rest_groups(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(cid, g): groups of the classes rest (cid, comp). Pairs across components that neither prefixes of the full sets nor signatures rule out lie in one group."""
    held = materialize(sets.join(rest.hint("merge"), "cid"), "rest-sets", "none")
    order = held.sparkSession.sparkContext.broadcast(rarity(held.select("data"), held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    posted = materialize(_postings(held, order, similarity, True).join(rest, "cid"), "rest-postings")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    # the values from the shared one on must suffice; classes of which few are left lie in blocks of their own
    left = (F.col("n") - F.col("place")) / F.col("n")
    parts = F.ceil(F.col("members") / BLOCK)
    blk = F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64("cid"), parts) * 8 + F.least(F.floor((1 - left) / (1 - similarity) * 8), F.lit(7)))
    rows = _with_lists(posted, lists.select("key", "members"), posted.count()).select("key", blk.alias("blk"), "cid", "comp", "n", (F.col("n") - F.col("place")).alias("left"), "sig")
    blocks = materialize(
        rows.groupBy("key", "blk").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("left").alias("most"), F.collect_list(F.struct("cid", "comp", "n", "left", "sig")).alias("m")
        ),
        "list-blocks",
    )
    short = blocks.select("key", "blk", "low", "high", "least", "most")
    other = short.toDF("key", "blk2", "low2", "high2", "least2", "most2")
    share = similarity / (1 + similarity)
    enough = F.least("most", "most2") >= share * (F.col("least") + F.col("least2")) - 1e-9
    meet = short.join(other, "key").where("blk <= blk2 AND NOT (low = high AND low2 = high2 AND low = low2)").where(enough).select("key", "blk", "blk2")
    met = meet.join(blocks.select("key", "blk", "m"), ["key", "blk"]).join(blocks.select("key", F.col("blk").alias("blk2"), F.col("m").alias("m2")), ["key", "blk2"])

    most = most_unlike(64 * REST_WORDS, similarity)

    def run(batches):
        for b in batches:
            for k, other, left, right in zip(*b.columns):
                sides = [left.values] if k == other else [left.values, right.values]
                cid, comp, n, rest_n = (np.concatenate([np.asarray(v.field(x)) for v in sides]) for x in ("cid", "comp", "n", "left"))
                sig = np.concatenate([_values(v.field("sig"))[1] for v in sides]).reshape(-1, REST_WORDS)
                rows = np.arange(len(left.values))
                cols = rows if k == other else np.arange(len(rows), len(cid))

                def near(x):
                    fits = (comp[cols] != comp[x]) & (np.minimum(n[cols], n[x]) >= similarity * np.maximum(n[cols], n[x]) - 1e-9)
                    enough = np.minimum(rest_n[cols], rest_n[x]) >= share * (n[cols] + n[x]) - 1e-9
                    return fits & enough & (np.bitwise_count(sig[cols] ^ sig[x]).sum(1) <= most)

                yield pa.RecordBatch.from_arrays(_ordered(cid, *_spanning(rows, cols, np.arange(len(cid)), near)), ["a", "b"])

    found = components(materialize(met.select("blk", "blk2", "m", "m2").mapInArrow(run, "a long, b long").distinct(), "rest-near"))
    return found.select(F.col("a").alias("cid"), F.col("b").alias("g")).unionByName(found.select(F.col("b").alias("cid"), F.col("b").alias("g")).distinct())


def _group_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within groups, of members (g, cid, comp, data): as few as join what all links would join.

    Each two blocks of a group meet with their full sets; pairs never are rows.
    """
    parts = F.least(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("data")) / GROUP_BYTES)), F.count(F.lit(1)))
    dealt = salted_join(members, members.groupBy("g").agg(parts.alias("parts")), "g", "cid").withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("parts")))
    dealt = dealt.select("g", "cid", "comp", "data", "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cid", "comp", "data", "blk")

    def compare(rows: pa.Table) -> pa.Table:
        i, j, cid, comp, blk = (np.asarray(rows.column(x)) for x in ("i", "j", "cid", "comp", "blk"))
        held, values = _values(rows.column("data"))
        codes, ends = np.unique(values, return_inverse=True)[1], np.cumsum(held)
        left, right = np.flatnonzero(blk == i[0]), np.flatnonzero(blk == j[0])
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        across = codes[np.repeat(blk == j[0], held)]
        starts, flag = np.cumsum(held[right]) - held[right], np.zeros(len(codes), bool)

        def linked(x):
            own = codes[ends[x] - held[x] : ends[x]]
            flag[own] = True
            both = np.add.reduceat(flag[across], starts, dtype=np.int64)
            flag[own] = False
            return 100 * both >= percent * (held[x] + held[right] - both)

        return pa.table(dict(zip("ab", _ordered(cid, *_spanning(left, right, np.unique(comp, return_inverse=True)[1], linked)))))

    return materialize(dealt.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "group-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, with_hash: bool = False, trace=None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and if asked for text_hash (xxhash64 of the text)."""
    say = trace or (lambda *_: None)
    similarity = percent / 100
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    signed = materialize(sketches(texts, n), "sketches")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    best = F.min(F.struct("doc_id", "text_hash", F.col("n_shingles").alias("n"), F.col("sketch").alias("data"), "sig")).alias("x")
    classes = materialize(real.groupBy("set_id").agg(best, F.count(F.lit(1)).alias("copies")).select("set_id", "copies", F.col("x.doc_id").alias("cid"), "x.text_hash", "x.n", "x.data", "x.sig"), "classes")
    texts = texts.where("doc_id IS NOT NULL")

    order = docs.sparkSession.sparkContext.broadcast(rarity(classes.select("data"), classes.agg(F.coalesce(F.sum(F.least("n", F.lit(K))), F.lit(0))).first()[0]))
    posted = materialize(_postings(classes, order, similarity, False), "postings")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("own", "cid", "n", "sig")).alias("lead")).where("members > 1")
    held = materialize(_with_lists(posted.select("key", "cid", "n", "sig"), lists, posted.count()), "lists")
    say("postings", lambda: posted.count(), lambda: held.count())
    m = F.col("m")
    most = most_unlike(64, similarity)
    fits = lambda x, y: (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9) & (F.bit_count(x["sig"].bitwiseXOR(y["sig"])) <= most)
    every = F.flatten(F.transform(m, lambda x: F.transform(F.filter(m, lambda y: (x["cid"] < y["cid"]) & fits(x, y)), lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b")))))
    short = held.where(F.col("members") <= SHORT_LIST).groupBy("key").agg(F.collect_list(F.struct("cid", "n", "sig")).alias("m")).select(F.explode(every).alias("p")).select("p.a", "p.b")
    star = held.where(F.col("members") > SHORT_LIST).where(F.col("cid") != F.col("lead.cid")).where(fits({x: F.col(x) for x in ("n", "sig")}, F.col("lead")))
    star = star.select(F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b"))
    pairs = materialize(short.unionByName(star).distinct(), "pairs")
    near = materialize(_promising(pairs, classes, similarity), "promising")
    asked = near.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(held.where(F.col("members") > SHORT_LIST).select("cid")).distinct()
    wanted = materialize(classes.select("cid", "text_hash").join(asked, "cid", "left_semi"), "wanted")
    sets = materialize(_full_sets(texts, wanted, n), "sets", "none")
    say("pairs", lambda: pairs.count(), lambda: near.count())
    links = _verified(near, sets, percent)
    done = components(links)
    say("links", lambda: links.count())

    # members of the long lists that still span components
    found = held.where(F.col("members") > SHORT_LIST).join(done.select(F.col("a").alias("cid"), F.col("b").alias("comp")), "cid", "left").select("key", "cid", "members", F.coalesce("comp", "cid").alias("comp"))
    found = materialize(found, "long-lists")
    open_ = found.groupBy("key").agg(F.max("members").alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "members")
    rest = materialize(_with_lists(found.select("key", "cid", "comp"), open_, held.count()).select("cid", "comp").distinct(), "rest")
    if not rest.isEmpty():
        grouped = _rest_groups(rest, sets, similarity)
        members = materialize(grouped.join(rest, "cid").join(sets.select("cid", "data").hint("merge"), "cid"), "group-sets", "none")
        late = _group_links(members, percent)
        say("rest", lambda: rest.count(), lambda: members.count(), lambda: late.count())
        if not late.isEmpty():
            done = components(done.unionByName(late))

    named = classes.join(done.select(F.col("a").alias("cid"), F.col("b").alias("comp")), "cid", "left").where("copies > 1 OR comp IS NOT NULL").select("set_id", F.coalesce("comp", "cid").alias("comp"))
    members = signed.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_id")).alias("set_id"))
    component = F.coalesce("comp", "doc_id")
    out = salted_join(members, named, "set_id", "doc_id", how="left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *["text_hash"] * with_hash)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), n=2)
