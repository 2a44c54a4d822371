"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which the tokenizer drops and never merges across. Each
distinct word of a block is asked for once, each distinct word of the corpus is encoded once (in the
bucket that all requests for it reach), and the ids are joined back by position. Decoding joins ids
with the table of pieces, whose size is that of the vocabulary file.

Defined results: null counts as empty and gives no ids; rows repeat as they do in the input; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import read_table, ship_package

VOCABULARY = "word_bpe_49k.json"
#: Words per call of the tokenizer.
CALL = 20_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Piece of each id."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size())], pa.large_string())


def plain_words(words: pa.Array) -> pa.Array:
    """Lower-cases A-Z, as the tokenizer does, but for words that may hold a special token."""
    return pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))


#: Words of lower-case Latin letters and closing marks: as many pre-tokens as parts, whatever stands beside them.
PLAIN = r"^[a-zß-öø-ÿ]+[.,!?;:]*$"
JOINED = 500


@lru_cache(maxsize=2)
def _ends(path: str) -> np.ndarray:
    """Whether the piece of each id ends a pre-token."""
    return np.asarray(pc.ends_with(pieces(path), "</w>"))


def _encode_each(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    t, counts, ids = tokenizer(path), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for at in range(0, len(words), CALL):
        found = [e.ids for e in t.encode_batch_fast(words.slice(at, CALL).to_pylist(), add_special_tokens=False)]
        counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter((i for e in found for i in e), np.uint32, int(counts[-1].sum())))
    return np.concatenate(counts), np.concatenate(ids)


def _encode_joined(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As _encode_each, for words like PLAIN: many at a time, told apart by the pieces that end a pre-token."""
    listed = words.to_pylist()
    texts = [" ".join(listed[at : at + JOINED]) for at in range(0, len(listed), JOINED)]
    counts, ids = _encode_each(pa.array(texts, pa.large_string()), path)
    parts = 1 + np.asarray(pc.match_substring_regex(words, "[.,!?;:]$")).astype(np.int64)
    ends = np.flatnonzero(_ends(path)[ids])
    if len(ends) != parts.sum():
        return _encode_each(words, path)
    return np.diff(ends[np.cumsum(parts) - 1], prepend=-1), ids


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids."""
    plain = np.asarray(pc.match_substring_regex(words, PLAIN)).astype(bool)
    if not plain.any() or path != default_vocabulary():
        return _encode_each(words, path)
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    n = int(plain.sum())
    (c1, i1), (c2, i2) = _encode_joined(words.take(pa.array(order[:n])), path), _encode_each(words.take(pa.array(order[n:])), path)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, at = spread(rank, np.concatenate([c1, c2]), np.concatenate([i1, i2]))
    return np.diff(at), ids


def spread(codes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of word codes, and the offset of each word in them."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = counts[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))
    return ids[at], np.concatenate([[0], ends])


def block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word offsets per document, word codes, distinct words of a block."""
    offsets, words = B.word_lists(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), lower=False)
    codes, distinct = B.distinct_words(plain_words(words))
    return offsets, codes, distinct


def encode_corpus(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """work(doc_ids, token offsets per document, ids) for each block of documents."""
    path = path or default_vocabulary()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_chars))
    blocks = B.pack_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], block_chars, parts=n)

    def routed(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket = B.bucket_of(B.hash_words(distinct), n)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], order

    def ask(table, n):
        _, _, distinct = block_words(table)
        bucket, order = routed(distinct)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for at, upto in zip(cuts, [*cuts[1:], len(bucket)]):
            yield int(bucket[at]), B.pack_table(pa.table({"w": distinct.take(pa.array(order[at:upto]))}))

    def answer(asked):
        lists = [B.unpack_table(d).column("w").combine_chunks() for d in asked]
        codes, distinct = B.distinct_words(pa.concat_arrays(lists))
        counts, ids = encode_words(distinct, path)
        at = 0
        for x in lists:
            mine = codes[at : at + len(x)]
            at += len(x)
            found, _ = spread(mine, counts, ids)
            yield B.pack_table(pa.table({"n": pa.array([B.pack_ints(counts[mine].astype(np.uint32))], pa.binary()), "ids": pa.array([B.pack_ints(found.astype(np.uint32))], pa.binary())}))

    replies = B.exchange(blocks, n, ask, answer, table=False)

    def finish(table, got):
        offsets, codes, distinct = block_words(table)
        bucket, order = routed(distinct)
        counts, parts = np.zeros(len(distinct), np.int64), []
        for k in np.unique(bucket):
            reply = B.unpack_table(got[int(k)])
            counts[order[bucket == k]] = B.unpack_ints(reply.column("n")[0].as_py(), np.uint32)
            parts.append(B.unpack_ints(reply.column("ids")[0].as_py(), np.uint32))
        # replies come in bucket order: bring the ids in order of the words
        by_bucket = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, at = spread(rank[codes], counts[order], by_bucket)
        return work(table.column("doc_id").combine_chunks(), at[offsets], ids)

    return B.with_replies(blocks, replies, finish, schema)


def decode(offsets: np.ndarray, ids: np.ndarray, path: str) -> pa.Array:
    """Texts that the tokenizer's decode gives: pieces joined by a space, for this file has no decoder."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces(path).take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """doc_id, ids: the token ids of each document."""

    def work(doc_ids, offsets, ids):
        return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))})

    return encode_corpus(docs, work, "doc_id long, ids array<int>", id_col, text_col, path, block_chars)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of a table (doc_id, ids)."""
    ship_package(encoded.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        for b in batches:
            lists = b.column(1).fill_null([])
            lengths = np.asarray(pc.list_value_length(lists), np.int64)
            texts = decode(np.concatenate([[0], np.cumsum(lengths)]), np.asarray(lists.flatten()).astype(np.uint32), path)
            yield pa.RecordBatch.from_arrays([b.column(0), texts.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str | None = None, block_chars: int = B.BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_vocabulary()

    def work(doc_ids, offsets, ids):
        raw, sha = ids.astype("<u4").tobytes(), lambda x: hashlib.sha256(x).hexdigest()
        texts = decode(offsets, ids, path)
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        return pa.table(
            {
                "doc_id": doc_ids,
                "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "ids_sha256": pa.array([sha(raw[4 * a : 4 * b]) for a, b in spans], pa.string()),
                "decoded_sha256": pa.array([sha(t.as_buffer() or b"") for t in texts], pa.string()),
            }
        )

    return encode_corpus(docs, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path=path, block_chars=block_chars)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))
