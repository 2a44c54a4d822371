import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing


def round_robin(totals, weights, window):
    """Token by token: the queue of each place in the stream, in plain deficit round-robin."""
    plan = packing.Schedule(totals, weights, 8, window)
    places = {}
    for q, t in totals.items():
        for at in range(t):
            ((start, size, place),) = plan.stream(q, at, at + 1)
            assert (start, size) == (0, 1) and place not in places
            places[place] = (q, at)
    return plan, [places[p] for p in range(sum(totals.values()))]


def test_schedule_is_a_round_robin():
    totals = {"a": 500, "b": 91, "c": 7}
    plan, stream = round_robin(totals, None, 40)
    for q in totals:  # in order within a queue
        assert [at for x, at in stream if x == q] == list(range(totals[q]))
    n = plan.phases[0][0]
    for q, t in totals.items():  # the deficit never reaches a whole token
        got = np.cumsum([x == q for x, _ in stream])
        for w in range(1, n + 1):
            end = sum(w * v // n for v in totals.values())
            assert got[end - 1] == w * t // n


def test_weights_hold_until_a_queue_runs_dry():
    totals = {"a": 300, "b": 300, "c": 50}
    plan, stream = round_robin(totals, {"a": 2, "b": 1}, 30)
    first = stream[:90]
    assert abs(sum(q == "a" for q, _ in first) - 60) <= 1 and not any(q == "c" for q, _ in first)
    assert sorted(stream) == sorted((q, k) for q, t in totals.items() for k in range(t))


def check(rows, got, length):
    t = bpe.tokenizer(bpe.default_vocabulary())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _ in rows}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, want in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    sizes = []
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert all(x == length or x & (x - 1) == 0 and x < length for x in sizes)
    assert sorted(seqs) == list(range(len(seqs)))


def test_pieces(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["sea", "harbour,", "Ünder", "x1"]) for _ in range(r.choice([1, 5, 50, 900]))), r.choice(["s0", "s0", "s1", "s2", None])) for i in range(120)]
    rows += [(500, None, "s1"), (501, "", None), (502, "sea " * 20_000, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"length": F.lit("clash"), "queue": F.lit(1)}).repartition(5)
    for length, weights in ((4096, None), (64, {"s0": 1.0, "s1": 3.0})):
        out = packing.pack_documents(df, length=length, window_sequences=4, weights=weights, with_ids=length == 64)
        check(rows, out.collect(), length)


def test_many_sources_are_queues_of_their_own(spark, monkeypatch):
    rows = [(i, "a b", f"source {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack_documents(df).collect()
    assert {r["doc_id"] for r in got} == set(range(600)) and sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    with pytest.raises(ValueError, match="no documents"):
        packing.pack_documents(df, weights={"elsewhere": 1.0})
    monkeypatch.setattr(packing, "MAX_QUEUES", 500)
    with pytest.raises(ValueError, match="different sources"):
        packing.pack_documents(df)


def test_word_memory_that_overflows(monkeypatch):
    """The same ids whether words are remembered, forgotten between slices, or never held at all."""
    slices = [pa.array(["the sea the sea", None, ""]), pa.array(["a Sea; of words, 12 words", "the sea"]), pa.array([], pa.string()), pa.array(["words of the sea again", "été <|endoftext|> x"])]
    tok = bpe.tokenizer(bpe.default_vocabulary())
    for bound in (600_000, 5, 0):
        monkeypatch.setattr(packing, "REMEMBERED", bound)
        memory = packing.WordIds(bpe.default_vocabulary())
        for texts in slices:
            offsets, ids = memory.encode(texts)
            for k, t in enumerate(texts.to_pylist()):
                assert np.array_equal(ids[offsets[k] : offsets[k + 1]], tok.encode(t or "", add_special_tokens=False).ids)
