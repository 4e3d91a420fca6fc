"""Chat formatting, in Spark expressions only.

Control strings (fixed values of the template): [INST] [/INST] <s> </s> [ROLE]
[TEXT] [/ROLE] [NEXT]. Runs of turns with the same role form one block; its
texts are joined by [NEXT]. In a text a backslash is doubled, and a control
string gets a backslash after its first character, so controls occur verbatim
only where the template put them and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([\[<])(/?INST\]|/?s>|/?ROLE\]|TEXT\]|NEXT\])"
BLOCK = r"(?s)(\[INST\] .*? \[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\])"
NEXT = "[NEXT]"
BLOCK_TURNS = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    return (
        F.when(role == "user", F.lit("[INST] "))
        .when(role == "assistant", F.lit("<s>"))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT]")))
    )


def _closing(role: Column) -> Column:
    return F.when(role == "user", F.lit(" [/INST]")).when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))


def _spans(pieces: Column) -> Column:
    """[start, end) of the bodies under the loss, in the order of pieces: within blocks of pieces first, then moved to where their block
    begins, so that no list grows by copies over a whole conversation."""
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["open"])
        end = start + F.length(x["body"])
        span = F.when(x["loss"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct((end + F.length(x["close"])).alias("at"), F.concat(state["spans"], span).alias("spans"))

    def moved(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        step = lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
        starts = F.aggregate(blocks, first, step, lambda s: s["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["spans"], lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end")))))

    last = F.floor((F.size(pieces) - 1) / BLOCK_TURNS).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(pieces, b * BLOCK_TURNS + 1, F.lit(BLOCK_TURNS)), begin, place))
    return F.get(F.transform(F.array(blocks), moved), F.lit(0))  # the lambda works blocks out once


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    turns needs conv_id, turn, role and text; other columns are ignored. Turns are
    sorted by (turn, role, text), nulls first, so ties have one order; repeated rows
    stay repeated turns. A null text or role counts as empty, a null conv_id is a
    conversation of its own. loss_spans holds [start, end) code-point offsets of
    each assistant text in formatted, without controls. Texts are taken whole; a conversation is one value, as its output is. No rows give no rows.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(all_turns: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(all_turns, i - 1)["role"])
            after = F.get(all_turns, i + 1)["role"]
            return F.struct(
                F.when(before.eqNullSafe(x["role"]), F.lit(NEXT)).otherwise(_opening(x["role"])).alias("open"),
                escape(x["text"]).alias("body"),
                F.when(after.eqNullSafe(x["role"]), F.lit("")).otherwise(_closing(x["role"])).alias("close"),
                (x["role"] == "assistant").alias("loss"),
            )

        return F.transform(all_turns, piece)

    cut = held.select("conv_id", pieces(F.col("turns")).alias("pieces"))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["open"], x["body"], x["close"])), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order), loss_texts: parsed back from formatted and loss_spans alone."""

    def parse(block: Column) -> Column:
        other = F.split_part(F.substring(block, 7, 1 << 30), F.lit("[TEXT]"), F.lit(1))
        role = F.when(block.startswith("[INST]"), F.lit("user")).when(block.startswith("<s>"), F.lit("assistant")).otherwise(unescape(other))
        skip = F.when(block.startswith("[INST]"), F.lit(7)).when(block.startswith("<s>"), F.lit(3)).otherwise(F.length(other) + 12)
        drop = F.when(block.startswith("[INST]"), F.lit(8)).when(block.startswith("<s>"), F.lit(4)).otherwise(F.lit(7))
        body = F.substring(block, skip + 1, F.length(block) - skip - drop)
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(1))
    span = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    return chats.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, parse)).alias("turns"),
        F.transform("loss_spans", span).alias("loss_texts"),
    )


def digest_chats(turns: DataFrame) -> DataFrame:
    """The query's columns, all read back from the formatted output."""
    back = read_chats(format_chats(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
