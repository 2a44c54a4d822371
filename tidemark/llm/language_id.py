"""Language identification with spans, by Viterbi over per-word scores.

Each distinct word gets a score per language: the mean log-probability of its character trigrams,
times the root of its length, under models learned from a bounded sample of texts per language. The script of a word's letters narrows
the languages to those that were learned with that script. Over the words of a text, Viterbi finds
the best sequence of languages with a penalty per switch, which labels spans of mixed texts; the
text's language is the one whose spans hold most letters, its score their share. All texts of a
slice are traversed in step.

Defined results: null texts and texts without a letter are `und` with score 0, as are all texts if no
language could be learned; words without letters take the language of their neighbours; ties go to
the language that sorts first; an empty table gives an empty result; other columns are ignored.
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
from tidemark.llm.samples import labelled_rows

PER_LANGUAGE = 600
BUCKETS = 1 << 15
SWITCH = 6.0
UNKNOWN = "und"
#: First code point of Unicode script ranges, and the script of each.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1400, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # BUCKETS x languages: log-probability of a trigram
    allowed: np.ndarray  # scripts x languages


def letter_trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and hashed trigram around each letter of lower-cased words, and the letter's script."""
    low = pc.utf8_lower(words)
    alone = pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", "")
    text = " " + " ".join(alone.to_pylist()) + " "
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == 32) - 1
    at = np.flatnonzero(c != 32)
    h = B.mix(c[at - 1] << np.uint64(42) | c[at] << np.uint64(21) | c[at + 1], 5) if len(at) else np.zeros(0, np.uint64)
    script = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])[np.searchsorted([b for b, _ in SCRIPTS], c[at], side="right") - 1]
    return word[at], (h % np.uint64(BUCKETS)).astype(np.int64), script


def word_scores(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word per language, and its number of letters."""
    n, k = len(words), len(model.languages)
    word, gram, script = letter_trigrams(words)
    marks = np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"\P{M}+", ""))).astype(np.int64)
    held = np.bincount(word, minlength=n)[:n]
    letters = np.maximum(held - marks, 0)  # combining marks shape trigrams, but are no letters
    out = np.zeros((n, k))
    for j in range(k):
        out[:, j] = np.bincount(word, model.logs[gram, j], n)[:n]
    out /= np.sqrt(np.maximum(held, 1))[:, None]
    # the script of most letters decides which languages compete
    main = np.zeros((n, len(SCRIPT_NAMES)), np.int64)
    np.add.at(main, (word, script), 1)
    allowed = model.allowed[main.argmax(1)] | (letters == 0)[:, None]
    some = allowed.any(1)
    out = np.where(allowed | ~some[:, None], out, -1e4)
    out[~some] = 0
    return out, letters


def viterbi(scores: np.ndarray, codes: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word position: the best sequence for each text, all texts in step."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    start, size = offsets[:-1][order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    k = scores.shape[1]
    v = np.zeros((len(order), k))
    came = np.zeros((len(codes), k), np.int16)
    counts = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        n = counts[t]
        at = start[:n] + t
        s = scores[codes[at]]
        if t:
            best = v[:n].argmax(1)
            top = v[np.arange(n), best][:, None] - switch
            stay = v[:n] >= top
            came[at] = np.where(stay, np.arange(k), best[:, None])
            v[:n] = np.maximum(v[:n], top) + s
        else:
            v[:n] = s
    label = np.zeros(len(codes), np.int16)
    now = v.argmax(1)
    for t in reversed(range(longest)):
        n = counts[t]
        at = start[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = came[at, now[:n]]
    return label


def fit(counts: np.ndarray, scripts: np.ndarray, languages: list[str]) -> Model:
    """counts: languages x BUCKETS of trigrams; scripts: languages x scripts of letters."""
    total = counts.sum(1, keepdims=True)
    logs = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T
    return Model(languages, np.ascontiguousarray(logs), (scripts >= np.maximum(1, 0.01 * scripts.sum(1, keepdims=True))).T)


def train(docs: DataFrame, usable, lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Model from texts with a language, of documents for which the column usable (over doc_id) holds."""
    ship_package(docs.sparkSession)
    sample, counts = labelled_rows(docs.withColumn(lang_col, F.col(lang_col).cast("string")), lang_col, usable, per_language)
    languages = sorted(counts)
    place = {x: k for k, x in enumerate(languages)}
    cells = BUCKETS + len(SCRIPT_NAMES)

    def grams(batches):
        total = {}
        for b in B.text_slices(batches, 0):
            offsets, words = B.word_lists(b.column(0))
            codes, distinct = B.distinct_words(words)
            of = np.repeat(np.array([place[x] for x in b.column(1).to_pylist()], np.int64), np.diff(offsets))
            word, gram, script = letter_trigrams(distinct)
            for k in np.unique(of):
                times = np.bincount(codes[of == k], minlength=len(distinct)).astype(np.float64)
                got = total.setdefault(int(k), np.zeros(cells))
                got[:BUCKETS] += np.bincount(gram, times[word], BUCKETS)
                got[BUCKETS:] += np.bincount(script, times[word], len(SCRIPT_NAMES))
        for k, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(got[at])], ["lang", "cell", "n"])

    found = np.zeros((len(languages), cells))
    rows = sample.select("text", "label").mapInArrow(grams, "lang long, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    for lang, cell, n in rows.collect() if languages else []:
        found[lang, cell] = n
    return fit(found[:, :BUCKETS], found[:, BUCKETS:], languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans: runs of words of one language (first, words, lang)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in B.text_slices(batches):
            n, k = b.num_rows, len(model.languages)
            offsets, words = B.word_lists(b.column(1))
            codes, distinct = B.distinct_words(words)
            doc = np.repeat(np.arange(n), np.diff(offsets))
            share = np.zeros((n, max(k, 1)))
            spans = [[] for _ in range(n)]
            if k and len(codes):
                scores, letters = word_scores(distinct, model)
                label = viterbi(scores, codes, offsets)
                share = np.bincount(doc * k + label, letters[codes], n * k).reshape(n, k)
                new = np.ones(len(codes), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                first = np.flatnonzero(new)
                for a, e in zip(first.tolist(), [*first[1:].tolist(), len(codes)]):
                    spans[doc[a]].append({"first": a - int(offsets[doc[a]]), "words": e - a, "lang": model.languages[label[a]]})
            total, best = share.sum(1), share.argmax(1)
            named = [model.languages[j] if t > 0 else UNKNOWN for j, t in zip(best, total)]
            score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, crc_remainder("doc_id", 5) != 0)
    return identify(docs, model).select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
