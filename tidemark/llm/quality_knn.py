"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text describe its form in any language: word shapes, pairs of shapes, repeats of recent
words, word lengths. Their frequencies are damped, weighted by inverse document frequency and
projected on the leading singular vectors of the labelled sample. The sample's vectors, at most
2 x PER_CLASS of DIMENSIONS numbers, go to every worker; each slice of documents is multiplied with
them in blocks, so every cosine is exact, and the NEIGHBOURS nearest vote with weights that grow with
similarity and restore the true shares of the labels.

Defined results: texts without words have no direction and get the share of label 1, as do all texts
when there are no labels; ties of similarity go to the earlier vector; rows repeat as in the input;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import crc_remainder, read_table, ship_package
from tidemark.llm.samples import labelled_sample

PER_CLASS = 1500
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 1024, 32, 15, 8.0
THRESHOLD = 0.3
ROWS = 512


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled vectors of length 1
    labels: np.ndarray
    votes: np.ndarray  # class weight of each labelled vector
    share: float


def term_frequencies(texts: pa.Array) -> np.ndarray:
    """Damped frequencies of the hashed terms of each text."""
    offsets, words = B.word_lists(texts, lower=False)
    lengths = np.diff(offsets)
    n = len(lengths)
    codes, distinct = B.distinct_words(words)
    if not len(codes):
        return np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), lengths)
    shape = distinct
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    shape_hash = B.hash_words(pc.utf8_slice_codeunits(shape, 0, 12))[codes]
    size_hash = B.mix(np.minimum(np.asarray(pc.utf8_length(distinct)).astype(np.uint64), 30), 17)[codes]
    low_codes = B.distinct_words(pc.utf8_lower(distinct))[0][codes]
    total = np.zeros(n * TERMS)

    def add(h: np.ndarray, of: np.ndarray, weight: float = 1.0) -> None:
        nonlocal total
        total += weight * np.bincount(of * TERMS + (h % np.uint64(TERMS)).astype(np.int64), minlength=n * TERMS)

    add(shape_hash, doc)
    add(size_hash, doc, 0.5)
    same = doc[1:] == doc[:-1]
    add(B.mix(shape_hash[:-1], shape_hash[1:])[same], doc[1:][same], 0.5)
    for back in (1, 2, 3, 4, 5, 10, 20):
        again = (doc[back:] == doc[:-back]) & (low_codes[back:] == low_codes[:-back])
        of = doc[back:][again]
        add(np.full(len(of), B.mix(np.uint64(back), 99)), of, 3.0)
    share = total.reshape(n, TERMS) / np.maximum(lengths, 1)[:, None]
    return np.log1p(50 * share).astype(np.float32)


def project(x: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = (x * weights) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit(x: np.ndarray, labels: np.ndarray, counts: dict[int, int]) -> Model:
    total = max(1, sum(counts.values()))
    share = counts.get(1, 0) / total if counts else 0.5
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2).astype(np.float32)
    axes = np.zeros((TERMS, DIMENSIONS), np.float32)
    if len(x):
        gram = (x * weights).T @ (x * weights)
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        axes = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    n1 = max(1, int(labels.sum()))
    votes = np.where(labels == 1, share / n1, (1 - share) / max(1, len(labels) - n1)).astype(np.float64)
    return Model(weights, axes, project(x, weights, axes).astype(np.float32), labels, votes, share)


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """Score of each row of term frequencies."""
    if not len(model.vectors):
        return np.full(len(x), model.share)
    v = project(x, model.weights, model.axes)
    cosine = v @ model.vectors.T
    k = min(NEIGHBOURS, cosine.shape[1])
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]  # the k-th nearest; of equals the earlier vectors
    above, equal = cosine > least, cosine == least
    near = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))[1].reshape(-1, k)
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS * model.votes[near]
    total = weight.sum(1)
    score = (weight * model.labels[near]).sum(1) / np.maximum(total, 1e-300)
    return np.clip(np.where((total > 0) & (x.sum(1) > 0), score, model.share), 0, 1)


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    ship_package(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label_col, usable, per_class)

    def vectors(batches):
        for b in B.text_slices(batches, 0):
            x = term_frequencies(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), b.column(1).cast(pa.int32())], ["x", "y"])

    rows = sorted((bytes(r["x"]), int(r["y"] == 1)) for r in sample.select("text", "label").mapInArrow(vectors, "x binary, y int").collect())
    x = np.array([np.frombuffer(r, np.float16) for r, _ in rows], np.float32).reshape(-1, TERMS)
    return fit(x, np.array([y for _, y in rows], np.int64), {0: sum(n for k, n in counts.items() if k != 1), 1: counts.get(1, 0)} if counts else {})


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in B.text_slices(batches):
            for at in range(0, b.num_rows, ROWS):
                c = b.slice(at, ROWS)
                score = vote(term_frequencies(c.column(1)), model)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return quality_scores(docs, model).select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
