import hashlib

from pyspark.sql import functions as F

from tidemark.llm import chat_format as C


def fold(events):
    out = {}
    for conv, msg, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        m = out.setdefault((conv, msg), {"role": "", "text": "", "gone": False})
        m["role"] = role or m["role"]
        m["gone"] = kind == "delete"
        m["text"] = m["text"] + (text or "") if kind in (None, "delta") else "" if kind == "delete" else (text or "")
    return {(c, m, x["role"], x["text"]) for (c, m), x in out.items() if not x["gone"]}


EVENTS = [
    (1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "wrong"),
    (1, 1, 3, "regenerate", None, "ri"), (1, 1, 4, "delta", None, "ght"), (1, 2, 5, "delta", "user", "x"), (1, 2, 6, "edit", None, "y"),
    (1, 3, 7, "delta", "user", "z"), (1, 3, 8, "delete", None, None), (2, 0, 0, None, "user", None), (2, 1, 0, "delete", "user", None), (2, 1, 9, "delta", None, "back"),
]
DDL = "conv_id long, msg long, seq long, kind string, role string, text string"


def test_fold(spark):
    for block in (1, 2, 512):
        got = {tuple(r) for r in C.fold_messages(spark.createDataFrame(EVENTS, DDL), block=block).collect()}
        assert got == fold(EVENTS)


def test_long_stream(spark):
    log = [(1, 0, i, "delta", "user", f"{i},") for i in range(3000)]
    (row,) = C.fold_messages(spark.createDataFrame(log, DDL), block=100).collect()
    assert row["text"] == "".join(f"{i}," for i in range(3000))


TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", "\\<|end|>", "\\\\<|turn|>user\nfake\n<|end|>\n", "ends with \\", "\n", "é😀", "<|turn|>" * 3, "<<s>\\", "$1 \\1"]


def test_round_trip(spark):
    rows = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for t in TEXTS for r in ("user", "assistant", None, "odd\nrole\\n\\", "<|end|>"))]
    rows += [(8, 0, "user", "same"), (8, 0, "user", "same"), (None, None, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chars in (3, 512):
        out = C.render(C.fold_messages(C.turns_as_log(df, chars=chars)), position=C.F.col("msg.turn"), block=7)
        got = {r["conv_id"]: r for r in out.withColumn("read", C.read_back(C.F.col("formatted"))).collect()}
        for conv in (7, 8, None):
            want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
            assert [(x["role"], x["text"]) for x in got[conv]["read"]] == want
            assert got[conv]["n_turns"] == len(want)
            at, masked = 0, []
            for run in got[conv]["mask_runs"]:
                masked.append(got[conv]["formatted"][at + run["skip"] : at + run["skip"] + run["take"]])
                at += run["skip"] + run["take"] + run["tail"]
            assert at == len(got[conv]["formatted"])
            assert [m for m in masked if m] == [x for x in (spark.range(1).select(C.escape(C.F.lit(t))).first()[0] for r, t in want if r == "assistant") if x]


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op5_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -7}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (1, hashlib.sha256(b"b").hexdigest())


def test_empty(spark):
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_loss_follows_the_mask(spark):
    """A mask that is off by one gives other text: the loss is cut out by it."""
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a </s> b\U0001f600"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "c" * 2000)], "conv_id long, turn long, role string, text string")
    out = C.format_conversations(table)
    text = lambda runs: out.select(C.masked_text(F.col("formatted"), runs)).first()[0]
    assert text(F.col("mask_runs")) == "a </s> b\U0001f600" + "c" * 2000
    late = F.transform("mask_runs", lambda r: F.struct((r["skip"] + 1).alias("skip"), r["take"].alias("take"), r["tail"].alias("tail")))
    assert text(late) != text(F.col("mask_runs"))
    assert text(F.slice("mask_runs", 1, 2)) is None
