"""Blocks of documents, and an exchange that looks up each distinct key of a block once.

A corpus is cut into blocks of bounded text size, written as one table (block, data). An operator
that needs a value for each word or n-gram of a block sends its distinct keys, packed, to buckets;
each bucket sees all requests for its keys, works out one value per distinct key and replies to each
block in the order asked. A key travels at most once per block, however often it occurs, so frequent
keys cause no skew, nothing grows with the corpus on the driver, and no table is broadcast. There
are as many buckets as blocks, so a bucket's share stays about one block's volume at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ship_package

BLOCK_CHARS = 8 << 20
BLOCK_SCHEMA = "block long, data binary"
MESSAGE_SCHEMA = "bucket long, block long, data binary"


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart, compressed."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else x.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def word_lists(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text, and the words [^\\x20\\x09-\\x0D]+ of all texts one after the other."""
    if texts.offset:  # ascii_lower misreads slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)])
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return offsets, words


def distinct_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes into the distinct words, and these in order of first appearance."""
    d = words.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    return pd.util.hash_array(np.asarray(words.to_pandas(), dtype=object), categorize=False)


def mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit hash of two hashes, in this order."""
    with np.errstate(over="ignore"):
        x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets by ranges of the 64-bit hash, so sorted keys lie in bucket order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack_blocks(docs: DataFrame, columns: list[str], block_chars: int = BLOCK_CHARS, parts: int | None = None) -> DataFrame:
    """Table (block, data) of docs; columns must hold `text`. Row order within a block is kept.

    With parts, no table is written: blocks lie hash-partitioned in one shuffle that all readers share.
    That saves a copy of the corpus on disk, and needs docs whose partitions repeat exactly when a lost
    one is read again, as those of files do.
    """
    ship_package(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal n, held, size
            data = pack_table(pa.Table.from_batches(held))
            out = pa.RecordBatch.from_pydict({"block": pa.array([(task << 24) + n], pa.int64()), "data": pa.array([data], pa.binary())})
            n, held, size = n + 1, [], 0
            return out

        for b in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0), np.int64)
            at = 0
            while at < b.num_rows:
                upto = at + int(np.searchsorted(np.cumsum(lengths[at:]), block_chars - size, side="left")) + 1
                upto = min(upto, b.num_rows)
                held.append(b.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
                if size >= block_chars:
                    yield close()
        if held:
            yield close()

    packed = docs.select(*columns).mapInArrow(pack, BLOCK_SCHEMA)
    return packed.repartition(parts, "block") if parts else materialize(packed, "blocks", "none")


def one_row(block=None, bucket=None, data: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})


def exchange(blocks: DataFrame, n: int, ask, answer, table: bool = True) -> DataFrame:
    """Table (bucket, block, data) of replies.

    ask(table, n) yields (bucket, data) for a block; answer([data, ...]) yields one reply per request,
    then any number of (None, data) of the bucket's own, which get the block -1.
    """

    def requests(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                for bucket, message in ask(unpack_table(data.as_py()), n):
                    yield one_row(block, bucket, message)

    def replies(rows: pa.Table) -> pa.Table:
        names, asked = rows.column("block").to_pylist(), rows.column("data").to_pylist()
        bucket = rows.column("bucket")[0].as_py()
        found = [one_row(names[k] if k < len(names) else -1, bucket, data) for k, data in enumerate(answer(asked))]
        return pa.Table.from_batches(found)

    sent = blocks.mapInArrow(requests, MESSAGE_SCHEMA)
    got = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(replies, MESSAGE_SCHEMA)
    return materialize(got, "replies", "none") if table else got


def with_replies(blocks: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """work(table, {bucket: data}) for each block, with the replies to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
        tables = [work(unpack_table(d), got) for d in left.column("data").to_pylist()]
        return pa.concat_tables(tables)

    return blocks.groupBy("block").cogroup(replies.where(F.col("block") >= 0).groupBy("block")).applyInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text column has a bounded size; a longer text is a slice of its own."""
    for b in batches:
        upto_size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(upto_size, (upto_size[at - 1] if at else 0) + size)))
            yield b.slice(at, upto - at)
            at = upto
