"""Toxicity by multiple-instance learning.

A text is a bag of sentences, a sentence a bag of words and beginnings of words. A sentence is offending with probability
sigmoid(b + sum of its words' weights), weights not negative; a text is toxic unless no sentence
offends: P = 1 - prod(1 - p) (noisy-or). Weights and b are trained from document labels alone by
gradient steps on the log-likelihood, and then locate the offending sentences.

Training uses about PER_CLASS labelled documents of each label (a bound, with class weights that
restore the true shares) and words that screening finds more often in toxic ones. The model has at
most MAX_WORDS weights; it goes to the workers with the code.

Defined results: null and empty texts hold no sentence and get the smallest score; without labels of
both kinds all scores are the share of label 1; rows repeat as in the input; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import crc_remainder, materialize, read_table, ship_package
from tidemark.llm.samples import labelled_sample

PER_CLASS = 3000
MAX_WORDS = 20_000
STEPS, RATE, DECAY = 400, 0.15, 2e-3
START = 1.0
MARKS = ".,;:!?\"'()[]{}«»“”¡¿*#$%&|<>+=~^_-"
#: Beginnings of longer words are features too, for inflected and compound forms.
PREFIXES = (5, 7)
THRESHOLD = 0.3


@dataclass
class Model:
    """Sorted word hashes with their weights; the bias of a sentence; a score for all texts if nothing could be learned."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


class Sentences:
    """Sentences of a slice of texts: lines, cut after words that end in . ! or ?"""

    def __init__(self, texts: pa.Array):
        if texts.offset:
            texts = texts.take(pa.array(np.arange(len(texts))))
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        line_doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lines)))
        flat = lines.flatten()
        offsets, words = B.word_lists(pa.concat_arrays([flat]) if not flat.offset else flat)
        line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.codes, self.words = B.distinct_words(words)
        stops = np.asarray(pc.match_substring_regex(self.words, "[.!?][\"')»”]*$")).astype(bool)[self.codes]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | stops[:-1]
        self.of_word = np.cumsum(new) - 1  # sentence of each word
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.doc = line_doc[line[self.first]] if len(line) else np.zeros(0, np.int64)
        self.n_docs = len(texts)
        bare = pc.utf8_trim(self.words, MARKS)
        length = np.asarray(pc.utf8_length(bare)).astype(np.int64)
        self.features = [B.hash_words(bare)]
        for k in PREFIXES:
            self.features.append(np.where(length > k, B.mix(B.hash_words(pc.utf8_slice_codeunits(bare, 0, k)), k), np.uint64(0)))

    def bag(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and their sentences, in order of sentences."""
        h = np.stack([f[self.codes] for f in self.features], axis=1).ravel()
        of = np.repeat(self.of_word, len(self.features))
        return h[h != 0], of[h != 0]

    def number(self) -> np.ndarray:
        """Place of each sentence in its text, from 0."""
        return np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit(keys: np.ndarray, lift: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int, int]], counts: dict[int, int]) -> Model:
    """Trains weights of the screened words keys, which start from lift.

    bags: for each text the places in keys that it holds, the sentence of each, its number of
    sentences, and its label; counts: the true counts of labels 0 and 1.
    """
    labels = np.array([y for *_, y in bags], np.int64)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not (n1 and n0 and len(keys)):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, share)
    rows, cols, doc, plain, at = [], [], [], np.zeros(len(bags)), 0
    for k, (place, sentence, n, _) in enumerate(bags):
        held, mine = np.unique(sentence, return_inverse=True)
        rows.append(mine + at)
        cols.append(place)
        doc += [k] * len(held)
        plain[k] = n - len(held)
        at += len(held)
    row, col, doc = np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64), np.array(doc, np.int64)
    cost = np.where(labels == 1, share / n1, (1 - share) / n0) * len(bags)
    w, b = np.maximum(lift, 0.0) + START, -6.0 - START  # each word's own log-odds above a plain sentence
    gw, gb = np.full(len(keys), 1e-8), 1e-8
    for _ in range(STEPS):
        p = np.minimum(_sigmoid(b + np.bincount(row, w[col], at)), 1 - 1e-9)
        base = min(float(_sigmoid(np.array(b))), 1 - 1e-9)
        log_none = np.bincount(doc, np.log1p(-p), len(bags)) + plain * np.log1p(-base)
        odds = np.exp(np.minimum(log_none, -1e-9))
        # d log-likelihood / d z of a sentence: -p for label 0, p (1-P)/P for label 1
        per_doc = cost * np.where(labels == 1, odds / np.maximum(1 - odds, 1e-9), -1.0)
        dz = p * per_doc[doc]
        grad = np.bincount(col, dz[row], len(keys)) / len(bags) - DECAY * w / len(keys)
        slope = (dz.sum() + base * (per_doc * plain).sum()) / len(bags)
        gw, gb = gw + grad**2, gb + slope**2
        w = np.maximum(w + RATE * 4 * grad / np.sqrt(gw), 0)
        b = b + RATE * 4 * slope / np.sqrt(gb)
    return Model(keys, w, float(b))


def sentence_scores(s: Sentences, model: Model) -> np.ndarray:
    weight = np.zeros(len(s.words))
    for f in s.features if len(model.keys) else []:
        at = np.minimum(np.searchsorted(model.keys, f), len(model.keys) - 1)
        weight += np.where(model.keys[at] == f, model.weights[at], 0.0)
    return _sigmoid(model.bias + np.bincount(s.of_word, weight[s.codes], len(s.doc)))


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Model from the labels of the documents for which the column usable (over doc_id) holds."""
    ship_package(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label_col, usable, per_class)

    sample = materialize(sample.select("text", F.when(F.col("label") == 1, 1).otherwise(0).alias("label")), "toxicity-sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)

    def presence(batches):
        """Number of texts of each label that hold a feature, per slice."""
        for b in B.text_slices(batches, 0):
            s = Sentences(b.column(0))
            h, of = s.bag()
            y = np.asarray(b.column(1)).astype(np.int64)
            order = np.lexsort((of if not len(s.doc) else s.doc[of], h))
            h, doc = h[order], (s.doc[of] if len(s.doc) else of)[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            keys, place = np.unique(h[new], return_inverse=True)
            in1 = np.bincount(place, y[doc[new]], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(in1), pa.array(np.bincount(place, minlength=len(keys)) - in1)], ["key", "in1", "in0"])

    # screening: words in more of the toxic texts than chance gives
    found = sample.mapInArrow(presence, "key long, in1 long, in0 long").groupBy("key").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    r1, r0 = F.col("in1") / F.lit(max(n1, 1)), (F.col("in0") + 0.5) / F.lit(n0 + 1)
    excess = (r1 - r0) / F.sqrt((r0 + 1.0 / max(n1, 1)) / F.lit(max(n1, 1)) + r0 / F.lit(max(n0, 1)))
    chosen = found.where((F.col("in1") >= min(3, n1)) & (r1 > 1.5 * r0) & (excess > 2.5)).orderBy(F.desc(excess), "key").limit(MAX_WORDS).collect() if n1 and n0 else []
    keys = np.array([r["key"] for r in chosen], np.int64).view(np.uint64)
    lift = np.array([np.log((r["in1"] + 0.1) / n1) - np.log((r["in0"] + 0.1) / n0) for r in chosen])
    order = np.argsort(keys)
    keys, lift = keys[order], lift[order]

    def hits(batches):
        """Screened words of each text, with their sentences."""
        for b in B.text_slices(batches, 0):
            s = Sentences(b.column(0))
            h, of = s.bag()
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            place, of = place[hit].astype(np.uint32), of[hit]
            cuts = np.searchsorted(s.doc[of] if len(of) else of, np.arange(s.n_docs + 1))
            spans, own = list(zip(cuts[:-1], cuts[1:])), of.astype(np.uint32)
            sentences = np.bincount(s.doc, minlength=s.n_docs)
            yield pa.RecordBatch.from_arrays([pa.array([place[a:e].tobytes() for a, e in spans], pa.binary()), pa.array([own[a:e].tobytes() for a, e in spans], pa.binary()), pa.array(sentences, pa.int64()), b.column(1).cast(pa.int32())], ["h", "s", "n", "y"])

    rows = sample.mapInArrow(hits, "h binary, s binary, n long, y int").collect() if len(keys) else []
    bags = [(np.frombuffer(r["h"], np.uint32), np.frombuffer(r["s"], np.uint32), r["n"], r["y"]) for r in rows]
    return fit(keys, lift, bags, {0: sum(c for k, c in counts.items() if k != 1), 1: counts.get(1, 0)})


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_sentences, offending: the sentences (number, p, text) with p of the threshold or more."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in B.text_slices(batches):
            s = Sentences(b.column(1))
            p = sentence_scores(s, model)
            score = noisy_or(p, s.doc, s.n_docs) if model.constant is None else np.full(s.n_docs, model.constant)
            number, ends, found = s.number(), np.append(s.first[1:], len(s.codes)), [[] for _ in range(s.n_docs)]
            for k in np.flatnonzero(p >= threshold) if model.constant is None else []:
                words = s.words.take(pa.array(s.codes[s.first[k] : ends[k]])).to_pylist()
                found[s.doc[k]].append({"sentence": int(number[k]), "p": float(p[k]), "text": " ".join(words)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(s.doc, minlength=s.n_docs).astype(np.int64)), pa.array(found, pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64()), ("text", pa.string())])))],
                ["doc_id", "score", "predicted", "n_sentences", "offending"],
            )

    schema = "doc_id long, score double, predicted int, n_sentences long, offending array<struct<sentence:int,p:double,text:string>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with all their columns, that score below the threshold: each is judged where it lies."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in B.text_slices(batches, at):
            s = Sentences(b.column(at))
            score = noisy_or(sentence_scores(s, model), s.doc, s.n_docs) if model.constant is None else np.full(s.n_docs, model.constant)
            yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the places of the offending sentences."""
    model = train(docs, labels, crc_remainder("doc_id", 4) != 2)
    out = toxicity(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_sentences", F.transform("offending", lambda x: x["sentence"]).alias("offending_sentences"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
