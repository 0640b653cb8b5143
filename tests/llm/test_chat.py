import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, seq long, op string, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<\\s> <s", "", None, "a\nb</s>\n<s>user\nx", "<<SYS>>é<</SYS>>", "[\\\\INST]", "<|im_end|>", "x" * 200_000, "\\", "<", "</s"]


def read(spark, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(extra))
    out = chat.format_chats(df).select("conv_id", "n_turns", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(1, k, k, "message", ["user", "assistant", "sys\ntem", None, "<s>"][k % 5], t) for k, t in enumerate(NASTY * 2)]
    out = read(spark, rows)[1]
    assert out.n_turns == len(rows) and [(t.role, t.text) for t in out.turns] == [(r[4] or "", r[5] or "") for r in rows]
    assert out.loss == "".join(r[5] or "" for r in rows if r[4] == "assistant")


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(0, 1, "message", "user", "hi"), (1, 2, "message", "assistant", "He"), (1, 3, "delta", None, "llo"), (1, 4, "regenerate", None, None), (1, 5, "delta", None, "Good "), (1, 6, "delta", None, "day"), (0, 7, "edit", None, "hello"), (2, 8, "delta", "user", "late"), (3, 9, "odd", "assistant", "x")]
    out = read(spark, [(5, t, s, o, r, x) for t, s, o, r, x in log])[5]
    assert [(t.role, t.text) for t in out.turns] == [("user", "hello"), ("assistant", "Good day"), ("user", "late"), ("assistant", "x")] and out.loss == "Good dayx"


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = [(1, 0, 0, "message", "user", "a")] * 2 + [(None, None, None, None, None, None), (1, None, 0, "message", "assistant", "b")]
    out = read(spark, rows)
    assert [t.text for t in out[1].turns] == ["b", "a", "a"] and out[None].n_turns == 1
    assert read(spark, []) == {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "|im_start|>", "a"]), max_size=8))
def test_escape_is_reversible(parts):
    import re


    text = "".join(parts)
    escaped = re.sub(chat.CONTROL, lambda m: m[1] + "\\" + m[2] + m[3], text)
    assert re.sub(chat.ESCAPED, lambda m: m[1] + m[2] + m[3], escaped) == text
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|im_", escaped)
