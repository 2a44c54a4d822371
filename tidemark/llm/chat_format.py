"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log has one row per event (conv_id, msg, seq, kind, role, text). Kinds:
  delta       appends its text to the message (streaming);
  edit        replaces what the message holds so far by its text;
  regenerate  discards what the message holds so far and starts again with its text;
  delete      removes the message unless later events write to it again.
Events are folded per message in order of seq, then messages per conversation in order of msg.
Folding is associative, so both run in two levels: blocks of bounded length first, then the blocks
of a message or conversation. A hot conversation is thereby spread over many tasks, and only one
row per block meets at the end, where the rendered conversation is one value by definition.

Template, per turn:  <|turn|>ROLE \\n TEXT \\n <|end|> \\n
A backslash goes in front of each control string inside a text and is taken away on reading. Roles
hold no line breaks once written: their backslashes and line breaks are written as \\\\ and \\n.

Defined results: null role, kind (delta) and text are '', '' and ''; null order keys sort first;
events that tie in seq are folded in order of kind, role and text; repeated rows of a conversation
table are turns of their own; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and of other common templates, none of which may appear raw in a text.
CONTROL_STRINGS = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_CONTROL = "|".join("".join("\\" + c if c in "<>|[]/" else c for c in s) for s in CONTROL_STRINGS)
EVENT_BLOCK, TURN_BLOCK = 512, 64
#: Code points per streamed delta when a table of whole turns is written as a log.
DELTA_CHARS = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_CONTROL})", "$1")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_messages(log: DataFrame, block: int = EVENT_BLOCK) -> DataFrame:
    """Final messages of a log: conv_id, msg, role, text. The keys conv_id and msg may be of any sortable type."""
    e = log.select(
        "conv_id",
        "msg",
        F.coalesce(F.col("seq"), F.lit(-1)).cast("long").alias("seq"),
        F.coalesce(F.col("kind"), F.lit("delta")).alias("kind"),
        F.col("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    events = F.col("events")
    last_reset = F.array_max(F.transform(events, lambda x, i: F.when(x["kind"] != "delta", i + 1).otherwise(0)))
    blocks = (
        e.groupBy("conv_id", "msg", F.floor(F.col("seq") / block).alias("blk"))
        .agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
        .select("conv_id", "msg", "blk", "events", last_reset.alias("reset"))
        .select(
            "conv_id",
            "msg",
            "blk",
            (F.col("reset") > 0).alias("reset"),
            (F.element_at(events, -1)["kind"] == "delete").alias("deleted"),
            F.array_join(F.transform(F.slice(events, F.greatest(F.col("reset"), F.lit(1)), F.size(events)), lambda x: F.when(x["kind"] == "delete", F.lit("")).otherwise(x["text"])), "").alias("text"),
            F.try_element_at(F.filter(F.transform(events, lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(-1)).alias("role"),
        )
    )
    parts = F.col("parts")
    return (
        blocks.groupBy("conv_id", "msg")
        .agg(F.sort_array(F.collect_list(F.struct("blk", "reset", "deleted", "text", "role"))).alias("parts"))
        .select("conv_id", "msg", "parts", F.greatest(F.array_max(F.transform(parts, lambda x, i: F.when(x["reset"], i + 1).otherwise(0))), F.lit(1)).alias("at"))
        .where(~F.element_at(parts, -1)["deleted"])
        .select(
            "conv_id",
            "msg",
            F.coalesce(F.try_element_at(F.filter(F.transform(parts, lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice(parts, F.col("at"), F.size(parts)), lambda x: x["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, position: Column | None = None, block: int = TURN_BLOCK) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, mask_runs.

    mask_runs has for each turn (skip, take, tail): code points outside the loss, under it, outside again.
    position: a bigint that grows with msg; turns are first joined in blocks of it.
    """
    position = F.col("msg").cast("long") if position is None else position
    head = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "msg", F.floor(F.coalesce(position, F.lit(-1)) / block).alias("blk"), "role", head.alias("head"), escape(F.col("text")).alias("body"))
    tail = f"\n{END}\n"
    loss = F.col("role") == "assistant"
    turn = F.struct(
        "msg",
        F.concat("head", "body", F.lit(tail)).alias("piece"),
        F.struct(F.char_length("head").alias("skip"), F.when(loss, F.char_length("body")).otherwise(0).alias("take"), (F.when(loss, 0).otherwise(F.char_length("body")) + len(tail)).alias("tail")).alias("run"),
    )
    blocks = (
        m.groupBy("conv_id", "blk")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.struct("blk", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("piece"), F.transform("turns", lambda t: t["run"]).alias("runs")).alias("b"))
    )
    return (
        blocks.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("b")).alias("bs"))
        .select(
            "conv_id",
            F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_turns"),
            F.array_join(F.transform("bs", lambda b: b["piece"]), "").alias("formatted"),
            F.flatten(F.transform("bs", lambda b: b["runs"])).alias("mask_runs"),
        )
    )


def _segments(formatted: Column) -> Column:
    """What follows each mark of a turn in a formatted conversation."""
    return F.filter(F.split(formatted, r"(?<!\\)<\|turn\|>"), lambda s, i: i > 0)


def masked_text(formatted: Column, mask_runs: Column) -> Column:
    """The text under the loss mask, cut out by the runs and unescaped; nothing stands between turns. Null if runs and turns differ in number."""
    cut = F.zip_with(_segments(formatted), mask_runs, lambda s, r: unescape(F.substring(s, r["skip"] - len(TURN) + 1, r["take"])))
    return F.when(F.size(_segments(formatted)) == F.size(mask_runs), F.array_join(cut, ""))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    tail = len(f"\n{END}\n")
    segments = _segments(formatted)

    def one(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        body = F.substring(s, F.char_length(role) + 2, F.char_length(s) - F.char_length(role) - 1 - tail)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(segments, one)


def turns_as_log(conversations: DataFrame, chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of a table of whole turns (conv_id, turn, role, text): each text streams in as deltas."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = c.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    msg = F.struct("turn", "role", F.xxhash64("text").alias("hash"), "copy")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    cut = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    return rows.select("conv_id", msg.alias("msg"), "role", F.posexplode(cut).alias("seq", "text")).select(
        "conv_id", "msg", "seq", F.lit("delta").alias("kind"), F.when(F.col("seq") == 0, F.col("role")).alias("role"), "text"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formats a table of whole turns through its event log."""
    return render(fold_messages(turns_as_log(conversations)), position=F.col("msg.turn"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = format_conversations(table.unionByName(planted)).withColumn("read", read_back(F.col("formatted")))
    loss = masked_text(F.col("formatted"), F.col("mask_runs"))
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_SQL_CONTROL = _CONTROL.replace("'", "''")
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum(length(role) + length(text) + len(regexp_extract_all(text, '{_SQL_CONTROL}')) + {len(TURN) + len(END) + 3})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
