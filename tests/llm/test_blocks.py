import re

import numpy as np
import pyarrow as pa

from tidemark.llm import blocks as B


def test_words_of_slices():
    texts = ["Ünder THE sea\x0b\x0c", None, "", " é  ÀB\x1c\x85c ", "日本 \tx\r\ny", "end"] * 5
    for at in (0, 1, 7):
        offsets, words = B.word_lists(pa.array(texts, pa.string()).slice(at))
        got = words.to_pylist()
        for k, t in enumerate(texts[at:]):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            assert got[offsets[k] : offsets[k + 1]] == re.findall(r"[^\x20\x09-\x0D]+", low)


def test_packed_ints():
    for dtype in (np.uint32, np.uint64):
        for x in (np.zeros(0, dtype), np.arange(1000, dtype=dtype) ** 2):
            assert (B.unpack_ints(B.pack_ints(x), dtype) == x).all()


def test_buckets_are_ranges():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    b = B.bucket_of(keys, 7)
    assert (np.diff(b) >= 0).all() and b.min() == 0 and b.max() == 6
