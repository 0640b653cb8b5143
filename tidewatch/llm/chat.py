"""Chat transcripts rebuilt from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>\n"
#: Control strings that no text may contain as such: an opening mark, then one of these tails.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)"

_MESSAGE = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    """One backslash more between the mark and the tail of every control string, escaped or not."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    held = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n"))
    return unescape(F.replace(held, F.lit("\x00"), F.lit("\\")))


def _fold(messages: Column, event: Column) -> Column:
    last = F.element_at(messages, -1)
    old = F.when(F.size(messages) > 0, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)
    text = (
        F.when(event.op == "delta", F.concat(last.text, event.text)).when(event.op == "edit", event.text).otherwise(F.lit(""))
    )
    changed = F.concat(old, F.array(F.struct(last.role.alias("role"), text.alias("text"))))
    added = F.concat(messages, F.array(F.struct(event.role.alias("role"), event.text.alias("text"))))
    return F.when((event.op == "message") | (F.size(messages) == 0), added).otherwise(changed)


def format_chats(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask) for a log (conv_id, turn, seq, op, role, text).

    Events of a turn are folded in the order of seq, then of op, role and text: `message` (also any unknown or null op)
    starts a message, `delta` appends to the turn's latest message, `edit` replaces its text, `regenerate` empties it for
    the deltas that follow; with no message yet, each of them starts one. Repeated `message` rows are repeated messages.
    Null texts and roles are empty, null turns come first, rows without conv_id form one conversation with a null id. Other columns are
    ignored; an empty log gives no rows.

    A message is written as OPEN, role, newline, text, CLOSE. Control strings in texts and roles get one backslash more,
    which `unescape` takes off again. loss_mask holds the code point intervals (start, end) of the texts of trained_role.
    Turns are folded and rendered on their own, spread by conversation and turn; only finished turns meet in a
    conversation, whose transcript is one value and must fit a row.
    """
    op = F.when(F.col("op").isin("delta", "edit", "regenerate"), F.col("op")).otherwise("message")
    event = F.struct(
        "seq", op.alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"))
    folded = F.aggregate("log", F.array().cast(f"array<{_MESSAGE}>"), _fold)
    rendered = turns.select("conv_id", "turn", F.posexplode(folded).alias("at", "m")).select(
        "conv_id",
        "turn",
        "at",
        (F.col("m.role") == trained_role).alias("trained"),
        F.concat(F.lit(OPEN), _escape_role(F.col("m.role")), F.lit("\n")).alias("head"),
        escape(F.col("m.text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    upto = Window.partitionBy("conv_id").orderBy("turn", "at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("upto") - len(CLOSE)
    parts = rendered.withColumn("upto", F.sum(size.cast("long")).over(upto)).select(
        "conv_id",
        F.struct(
            "upto",
            F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
            F.when(F.col("trained"), F.struct((end - F.length("body")).alias("start"), end.alias("end"))).alias("span"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p.segment), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p.span), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a transcript."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(
        body,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing between."""
    cut = F.transform(loss_mask, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return F.array_join(cut, "")
