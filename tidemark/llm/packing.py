"""Packing of token sequences with a controlled mixture of sources.

Each source is a queue of tokens. Deficit round-robin serves all queues once per window: source s
gets the whole tokens of its target share of the window, and the fraction that is left is its deficit,
carried to the next window. Served tokens of successive windows form one stream, cut into sequences
of LENGTH, so only the end of the stream is short; it is laid out in sequences of powers of two,
which need no padding. When a queue with a set target runs dry, the rest share its part (a new phase).

Because documents may be cut anywhere, round-robin has a closed form: after w of a phase's n windows
source s has been served floor(w t_s / n) of its t_s tokens. A document's place follows from its
position in its source's queue alone, and that from running totals per (chunk, source). Windows and
deficits so pass over partitions without any task seeing a whole queue; the driver holds one total
per source, and more than MAX_QUEUES sources are refused.

Without weights the targets are the corpus's own proportions, and every window mirrors the corpus.

Defined results: null and empty texts hold only the end id; null sources are a queue of their own;
repeated rows are packed as often as they occur; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm import bpe
from tidemark.llm.common import materialize, read_table, ship_package, small_enough

LENGTH = 4096
END_ID = 2
#: Tokens of a window, in sequences.
WINDOW_SEQUENCES = 64
MAX_QUEUES = 1_000_000
#: Slots of windows that a Python worker remembers, 24 bytes each.
REMEMBERED_SLOTS = 2_000_000
#: Text bytes that are encoded at a time.
SLICE_BYTES = 4 << 20
#: Words that a Python worker remembers between slices.
REMEMBERED = 600_000
#: Rows of (chunk, source) that are broadcast at most, about 30 bytes each.
BROADCAST_ROWS = 100_000


class WordIds:
    """Ids of words, remembered up to a bound."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those remembered, new ones added."""
        found = pc.index_in(words, value_set=self.words)
        if len(self.words) + found.null_count > REMEMBERED:
            self.clear()
            found = pc.index_in(words, value_set=self.words)
        unknown = pc.is_null(found)
        places = np.asarray(pc.fill_null(found, 0)).astype(np.int64)
        if found.null_count:
            new = words.filter(unknown)
            counts, ids = bpe.encode_words(new, self.path)
            places[np.asarray(unknown)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
            self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token offsets per text, and ids."""
        offsets, words = B.word_lists(texts, lower=False)
        codes, distinct = B.distinct_words(bpe.plain_words(words))
        if not len(codes):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        known = self._places(distinct)[codes]
        n = self.counts[known]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[known] - (ends - n), n) + np.arange(int(ends[-1]))
        return np.concatenate([[0], ends])[offsets], self.ids[at]


_word_ids: dict[str, WordIds] = {}


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Table (chunk, doc_id, queue, n, chunk_pos, ids) of docs (doc_id, text, queue); chunk_pos counts the tokens of the queue before it in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, before = TaskContext.get().partitionId(), {}
        memory = _word_ids.setdefault(path, WordIds(path))
        for whole in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64))
            at = 0
            while at < whole.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
                b = whole.slice(at, upto - at)
                at = upto
                offsets, ids = memory.encode(b.column(1))
                place, data = [], []
                lengths = (np.diff(offsets) + 1).tolist()
                queues = b.column(2).to_pylist()
                wide = ids.astype("<u4")
                last = np.array([end_id], "<u4")
                for k, (q, n) in enumerate(zip(queues, lengths)):
                    place.append(before.get(q, 0))
                    before[q] = place[-1] + n
                    own = np.concatenate([wide[offsets[k] : offsets[k + 1]], last])
                    data.append(own.astype("<u2").tobytes() if small else own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * b.num_rows, pa.int64()), b.column(0), b.column(2), pa.array(lengths, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary())],
                    ["chunk", "doc_id", "queue", "n", "chunk_pos", "ids"],
                )

    small = bpe.tokenizer(path).get_vocab_size() < 1 << 16 and end_id < 1 << 16
    return materialize(docs.mapInArrow(run, "chunk long, doc_id long, queue string, n long, chunk_pos long, ids binary"), "tokens")


class Schedule:
    """Places of queue positions in the packed stream."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW_SEQUENCES * LENGTH):
        self.queues = sorted(totals)
        self.number = {q: k for k, q in enumerate(self.queues)}
        self.length, self.total = length, sum(totals.values())
        left = np.array([totals[q] for q in self.queues], np.int64)
        start, base, self.phases = np.zeros(len(left), np.int64), 0, []
        while left.any():
            share = np.array([float(weights.get(q, 0.0)) if weights else 0.0 for q in self.queues])
            share[left == 0] = 0
            if share.any():
                full = np.flatnonzero(share)
                dry = full[np.argmin(left[full] / share[full])]
                served = np.minimum(left, np.floor(share * (left[dry] / share[dry])).astype(np.int64))
                served[dry] = left[dry]
            else:  # no targets for what is left: its own proportions
                served = left.copy()
            n = max(1, -(-int(served.sum()) // window))
            self.phases.append((n, served, start.copy(), base))
            start, left, base = start + served, left - served, base + int(served.sum())
        self.full = self.total // length
        self.tail, rest = [], self.total % length
        for power in reversed(range(length.bit_length())):
            if rest >> power & 1:
                self.tail.append(1 << power)
        self._windows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _upto(w: int, n: int, served: np.ndarray) -> np.ndarray:
        """Tokens of each queue that w windows of n have served: floor(w served / n), without overflow."""
        return w * (served // n) + w * (served % n) // n

    def _window(self, phase: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a window: place in the stream of each queue's slot, and the slot's bounds in the phase's queues."""
        if (phase, w) not in self._windows:
            if len(self._windows) > 4 + REMEMBERED_SLOTS // max(1, len(self.queues)):
                self._windows.clear()
            n, served, _, base = self.phases[phase]
            a, b = self._upto(w, n, served), self._upto(w + 1, n, served)
            self._windows[phase, w] = (base + int(a.sum()) + np.cumsum(b - a) - (b - a), a, b)
        return self._windows[phase, w]

    def stream(self, queue: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, place in the stream) of the parts of positions a to b of a queue."""
        s, first = self.number[queue], a
        for phase, (n, served, start, _) in enumerate(self.phases):
            t, lead = int(served[s]), int(start[s])
            while a < b and lead <= a < lead + t:
                own = a - lead
                w = -(-(own + 1) * n // t) - 1
                slot, low, high = self._window(phase, w)
                upto = min(b, lead + int(high[s]))
                yield a - first, upto - a, int(slot[s]) + own - int(low[s])
                a = upto

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a part of the stream."""
        done = 0
        while done < length:
            p = place + done
            if p < self.full * self.length:
                seq, off = divmod(p, self.length)
                room = self.length - off
            else:
                off, seq = p - self.full * self.length, self.full
                for size in self.tail:
                    if off < size:
                        break
                    off, seq = off - size, seq + 1
                room = size - off
            take = min(room, length - done)
            yield done, take, seq, off
            done += take


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    path: str | None = None,
    end_id: int = END_ID,
    weights: dict[str, float] | None = None,
    length: int = LENGTH,
    window_sequences: int = WINDOW_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    path = path or bpe.default_vocabulary()
    ship_package(docs.sparkSession)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if not small_enough(docs.select(source.alias("q")).distinct(), MAX_QUEUES):
        raise ValueError(f"more than {MAX_QUEUES} different sources")
    tokens = token_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), source.alias("queue")), path, end_id)
    held = tokens.groupBy("chunk", "queue").agg(F.sum("n").alias("m"))
    chunks = materialize(held.selectExpr("chunk", "queue", "m", "coalesce(sum(m) OVER (PARTITION BY queue ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead"), "chunk-leads")
    totals = {r["queue"]: r["t"] for r in chunks.groupBy("queue").agg(F.sum("m").alias("t")).collect()}
    if totals and weights and not set(weights) <= set(totals):
        raise ValueError(f"no documents of the sources {sorted(set(weights) - set(totals))}")
    plan = Schedule(totals, weights, length, window_sequences * length)
    leads = chunks.select("chunk", "queue", "lead")
    placed = tokens.join(F.broadcast(leads) if small_enough(leads, BROADCAST_ROWS) else leads, ["chunk", "queue"]).select("doc_id", "queue", "n", (F.col("lead") + F.col("chunk_pos")).alias("at"), "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, q, n, at, raw in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                data = raw.as_buffer()
                ids = np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4").astype("<u4")
                for start, size, place in plan.stream(q, at, at + n):
                    for s, k, seq, off in plan.cut(place, size):
                        own = ids[start + s : start + s + k]
                        out.append((doc_id, start + s, k, zlib.crc32(own), n, seq, off, *([own.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*out)) or [[] for _ in range(7 + with_ids)]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return placed.mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
