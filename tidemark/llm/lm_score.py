"""Language-model scoring with a weighted backoff automaton over bigrams.

Tokens are the lower-cased (A-Z) words of a text and one end. Training counts of words and bigrams
come from all documents that are not held out, summed in the buckets of a block exchange, so the
model lives in the shared table of replies and grows with the corpus, not on the driver or in a
broadcast. The model interpolates: P(w|h) = L(h) c(hw)/c(h) + (1 - L(h)) P(w), with P(w) additive
over words. L depends on the size class of c(h) and is fitted by leave-one-out likelihood over all
training tokens, from a histogram of bounded size.

For each block of documents the needed part of the automaton is laid out: one state per word seen
in training and one for the start, an arc for each seen bigram with its interpolated log-probability,
and a failure arc to the root with log(1 - L(h)). Texts are then traversed from left to right, all
texts of a block in step: a state takes its arc if it has one for the next token; otherwise it pays
the failure arc and the root's word arc. Long texts are cut into segments, each of which starts in
the state that the token before it leads to, so the sums equal those of one traversal.

Defined results: null and empty texts hold only the end; null ids are training rows or not by the
crc32 of the empty text; repeated rows count as often as they occur; an empty table, or one without
training rows, is scored by the additive part alone; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import read_table

ADD = 0.1
SEGMENT = 1024
#: Hash stand-ins of the two tokens that no text can hold.
END, START = np.uint64(0x5EED5EED00000001), np.uint64(0x5EED5EED00000002)
#: Histogram of log10(c(hw|h) / P(w)) when fitting L: bins of 1/8 from -8 to 12; the first is for ratio 0.
RATIO_BINS, RATIO_LOW, RATIO_STEP = 162, -8.0, 0.125
CLASSES = 48


def _held_out(doc_ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in doc_ids.to_pylist()), bool, len(doc_ids))


class Tokens:
    """Tokens of a block: hashes of words with one end per text, and which occurrences are training."""

    def __init__(self, table: pa.Table, modulus: int, remainder: int):
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        offsets, words = B.word_lists(text)
        codes, distinct = B.distinct_words(words)
        hashes = B.hash_words(distinct)
        n = len(offsets) - 1
        self.doc_ids = table.column("doc_id").combine_chunks()
        self.held_out = _held_out(self.doc_ids, modulus, remainder)
        self.offsets = offsets + np.arange(n + 1)
        is_end = np.zeros(self.offsets[-1], bool)
        is_end[self.offsets[1:] - 1] = True
        self.tokens = np.full(len(is_end), END)
        self.tokens[~is_end] = hashes[codes]
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.offsets[:-1]] = START
        self.train = np.repeat(~self.held_out, np.diff(self.offsets))
        self.doc = np.repeat(np.arange(n), np.diff(self.offsets))
        self.n_train_docs = int((~self.held_out).sum())

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of words (START counts training texts) and of bigrams, with their places among the tokens."""
        words, word_at = np.unique(np.append(self.tokens, START), return_inverse=True)
        pairs, pair_at = np.unique(B.mix(self.before, self.tokens), return_inverse=True)
        return words, word_at, pairs, pair_at


def _counts(places: np.ndarray, n: int, train: np.ndarray) -> np.ndarray:
    return np.bincount(places[train], minlength=n)


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(B.bucket_of(keys, n), np.arange(n + 1))


def _pack(keys: np.ndarray, counts: np.ndarray) -> dict:
    return {"k": pa.array([B.pack_ints(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "c": pa.array([B.pack_ints(counts.astype(np.uint32))], pa.binary())}


def _requests(table: pa.Table, n: int, modulus: int, remainder: int):
    t = Tokens(table, modulus, remainder)
    words, word_at, pairs, pair_at = t.keys()
    wc = _counts(word_at[:-1], len(words), t.train)
    wc[word_at[-1]] = t.n_train_docs
    pcounts = _counts(pair_at, len(pairs), t.train)
    wcut, pcut = _cuts(words, n), _cuts(pairs, n)
    for k in range(n):
        a, b, c, d = wcut[k], wcut[k + 1], pcut[k], pcut[k + 1]
        if a < b or c < d:
            w, p = _pack(words[a:b], wc[a:b]), _pack(pairs[c:d], pcounts[c:d])
            yield k, B.pack_table(pa.table({"wk": w["k"], "wc": w["c"], "pk": p["k"], "pc": p["c"]}))


def _answers(asked):
    tables = [B.unpack_table(d) for d in asked]
    replies = [{} for _ in asked]
    totals = {}
    for kind in "wp":
        keys = [np.cumsum(B.unpack_ints(t.column(kind + "k")[0].as_py(), np.uint64), dtype=np.uint64) for t in tables]
        counts = np.concatenate([B.unpack_ints(t.column(kind + "c")[0].as_py(), np.uint32) for t in tables])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        found, at = total[place], 0
        for r, k in zip(replies, keys):
            r[kind] = pa.array([B.pack_ints(found[at : at + len(k)].astype(np.uint64))], pa.binary())
            at += len(k)
        if kind == "w":
            real = distinct != START
            totals = {"n": int(total[real].sum()), "v": int((total[real] > 0).sum())}
    for r in replies:
        yield B.pack_table(pa.table(r))
    yield B.pack_table(pa.table({"n": [totals["n"]], "v": [totals["v"]]}))


def _gather(got: dict, kind: str) -> np.ndarray:
    """Counts of all keys of a block: buckets are ranges of keys, so replies follow each other."""
    parts = [B.unpack_ints(B.unpack_table(got[k]).column(kind)[0].as_py(), np.uint64) for k in sorted(k for k in got if k is not None)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), CLASSES - 1)


def fit_weights(histogram: np.ndarray) -> np.ndarray:
    """L of each size class: maximises the leave-one-out likelihood of its histogram row by EM."""
    ratio = 10 ** (RATIO_LOW + RATIO_STEP * (np.arange(RATIO_BINS) - 0.5))
    ratio[0] = 0.0
    out = np.zeros(len(histogram))
    for k, h in enumerate(histogram):
        if h.sum() == 0:
            continue
        x = 0.5
        for _ in range(200):
            x = min(float((h * x * ratio / (x * ratio + 1 - x)).sum() / h.sum()), 0.999)
        out[k] = min(max(x, 1e-4), 0.999)
    return out


class Automaton:
    """States, arcs and failure arcs that the texts of one block need."""

    def __init__(self, t: Tokens, got: dict, total: int, distinct: int):
        self.words, self.word_at, self.pairs, self.pair_at = t.keys()
        self.wc, self.pc = _gather(got, "w"), _gather(got, "p")
        self.p1 = (np.where(self.words == START, 0, self.wc) + ADD) / (total + ADD * (distinct + 1))
        first = np.zeros(len(self.pairs), np.int64)
        first[self.pair_at[::-1]] = np.arange(len(t.tokens))[::-1]
        self.pair_word = self.word_at[:-1][first]
        self.pair_state = np.searchsorted(self.words, t.before[first])

    def ratios(self, t: Tokens) -> np.ndarray:
        """Histogram [class, bin] of the training tokens of this block, each left out of its own counts."""
        c, h = self.pc[self.pair_at] - 1, self.wc[self.pair_state[self.pair_at]] - 1
        use = t.train & (h > 0)
        c, h, p = c[use], h[use], self.p1[self.word_at[:-1][use]]
        with np.errstate(divide="ignore"):
            r = np.log10(c / h / p)
        bins = np.where(c > 0, np.clip(np.floor((r - RATIO_LOW) / RATIO_STEP) + 1, 1, RATIO_BINS - 1), 0).astype(np.int64)
        return np.bincount(size_class(h) * RATIO_BINS + bins, minlength=CLASSES * RATIO_BINS)

    def weigh(self, weights: np.ndarray) -> None:
        """Lays out states, arcs and failure arcs."""
        mixed = np.where(self.wc > 0, weights[size_class(self.wc)], 0.0)
        self.fail = np.log10(1 - mixed)
        self.is_state = self.wc > 0
        self.root_arc = np.log10(self.p1)
        seen = self.pc > 0
        s, w = self.pair_state[seen], self.pair_word[seen]
        self.arc_key = self.pairs[seen]
        self.arc_log = np.log10(mixed[s] * self.pc[seen] / np.maximum(self.wc[s], 1) + (1 - mixed[s]) * self.p1[w])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log-probabilities. States and words are places in self.words; -1 is the root."""
        log = self.root_arc[word]
        held = np.flatnonzero(state >= 0)
        if len(held) and len(self.arc_key):
            key = B.mix(self.words[state[held]], self.words[word[held]])
            at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[at] == key
            log[held] = np.where(hit, self.arc_log[at], log[held] + self.fail[state[held]])
        elif len(held):
            log[held] += self.fail[state[held]]
        return np.where(self.is_state[word], word, -1), log

    def traverse(self, t: Tokens) -> np.ndarray:
        """Log-probability of each text."""
        lengths = np.diff(t.offsets)
        pieces = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        start = t.offsets[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(start + SEGMENT, t.offsets[doc + 1])
        order = np.argsort(start - end, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
        state = np.searchsorted(self.words, t.before[start])
        state = np.where(self.is_state[state], state, -1)
        total, size = np.zeros(len(doc)), end - start
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, side="left"))  # segments longer than k
            state[:n], log = self.step(state[:n], self.word_at[start[:n] + k])
            total[:n] += log
        return np.bincount(doc, total, len(lengths)) if len(doc) else np.zeros(len(lengths))


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, remainder: int = 0, block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns where crc32(id) mod modulus is not remainder."""
    blocks = B.pack_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], block_chars)
    n = max(1, blocks.count())
    replies = B.exchange(blocks, n, lambda table, k: _requests(table, k, modulus, remainder), _answers)

    def sums(batches):
        for b in batches:
            for data in b.column(0):
                x = B.unpack_table(data.as_py())
                yield pa.RecordBatch.from_arrays([x.column("n").combine_chunks(), x.column("v").combine_chunks()], ["n", "v"])

    total, distinct = replies.where("block = -1").select("data").mapInArrow(sums, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def ratios(table, got):
        t = Tokens(table, modulus, remainder)
        h = Automaton(t, got, total, distinct).ratios(t)
        at = np.flatnonzero(h)
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(h[at], pa.int64())})

    histogram = np.zeros(CLASSES * RATIO_BINS)
    for cell, k in B.with_replies(blocks, replies, ratios, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        histogram[cell] = k
    weights = fit_weights(histogram.reshape(CLASSES, RATIO_BINS))

    def score(table, got):
        t = Tokens(table, modulus, remainder)
        a = Automaton(t, got, total, distinct)
        a.weigh(weights)
        words = a.word_at[:-1]
        docs_in = len(t.offsets) - 1
        return pa.table(
            {
                "doc_id": t.doc_ids,
                "held_out": pa.array(t.held_out),
                "n_tokens": pa.array(np.diff(t.offsets), pa.int64()),
                "n_known": pa.array(np.bincount(t.doc, a.wc[words] > 0, docs_in).astype(np.int64)),
                "train_tokens": pa.array(np.full(docs_in, total), pa.int64()),
                "base_score": pa.array(np.bincount(t.doc, a.root_arc[words], docs_in)),
                "score": pa.array(a.traverse(t)),
            }
        )

    return B.with_replies(blocks, replies, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read_table(spark, sf_dir, "documents"))

