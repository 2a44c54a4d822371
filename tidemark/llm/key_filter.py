"""Which rows may have a key among many: bits of a fixed size for all tasks.

Rows that the bits rule out need not travel; the others meet the keys in an exact join, so results never
rest on the bits. Their size does not grow: with very many keys more rows pass and travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.common import ship_package

#: Bits of the filter, and parts in which they are gathered.
FILTER_BITS, SHARDS = 1 << 26, 64


def _bits(keys: np.ndarray) -> np.ndarray:
    """Two places of each key in the filter."""
    h = B.mix(keys.astype(np.int64).view(np.uint64), 23)
    return np.concatenate([h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def key_filter(keys: DataFrame):
    """Broadcast bits of keys (one bigint column)."""
    ship_package(keys.sparkSession)
    width = FILTER_BITS // SHARDS

    def mark(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[_bits(np.asarray(b.column(0)))] = True
        for k in range(SHARDS):
            at = np.flatnonzero(bits[k * width : (k + 1) * width])
            if not len(at):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([B.pack_ints(np.diff(at, prepend=0).astype(np.uint32))], pa.binary())], ["shard", "at"])

    def add(rows: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        for at in rows.column("at"):
            bits[np.cumsum(B.unpack_ints(at.as_py(), np.uint32), dtype=np.int64)] = True
        return pa.table({"shard": rows.column("shard").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for shard, bits in keys.mapInArrow(mark, "shard int, at binary").groupBy("shard").applyInArrow(add, "shard int, bits binary").collect():
        out[shard * width // 8 : (shard + 1) * width // 8] = np.frombuffer(bytes(bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_hold(bits, keys: np.ndarray) -> np.ndarray:
    """Whether the filter cannot rule out the keys."""
    at = _bits(keys)
    hit = (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)


def may_be_in(bits, key: Column) -> Column:
    """may_hold of a bigint column without nulls; only the key goes to Python."""

    @F.arrow_udf("boolean")
    def ask(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits, np.asarray(keys)))

    return ask(key)
