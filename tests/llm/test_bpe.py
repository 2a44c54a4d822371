import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import bpe

ODD = [
    None, "", " \n\t\x0b\x0c\r", "Hello, World's it's THE 123 4,5", "é é́ é ́x a ́b", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|", "x y z　w", "Σίσυφος ΣΑΣ İI",
    "日本語 текст 😀👍🏽 ‍", "\x00\x1c\x1d\x85", "don't 'S 'll ''", "w" * 5000, "the " * 3000, "﻿bom �",
]


def rows():
    r = random.Random(3)
    chars = "abcXYZ .,'!\n\té<|>0123ßΣ́ 日"
    return list(enumerate(ODD + ["".join(r.choice(chars) for _ in range(r.randint(0, 200))) for _ in range(150)]))


def test_against_library(spark):
    data = rows()
    t = bpe.tokenizer(bpe.default_vocabulary())
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    for block_chars in (500, 1 << 20):
        got = {r["doc_id"]: r for r in bpe.bpe_digests(df, block_chars=block_chars).collect()}
        assert len(got) == len(data)
        for i, text in data:
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids), text
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
            assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_encode_then_decode(spark):
    data = rows()
    t = bpe.tokenizer(bpe.default_vocabulary())
    enc = bpe.bpe_encode(spark.createDataFrame(data, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(enc).collect()}
    assert got == {i: t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, x in data}


def test_empty(spark):
    assert bpe.bpe_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
