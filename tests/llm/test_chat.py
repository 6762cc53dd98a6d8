from __future__ import annotations

from eventloom.llm import chat


def segments(spark, rows):
    table = spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, turn long, role string, text string, position int")
    out = chat.preference_segments(table).orderBy("pair_id", "part", "position").collect()
    return [(r.pair_id, r.part, r.position, r.role, r.segment[r.trained_from : r.trained_to] if r.trained_to else None) for r in out]


def test_prompt_is_the_longest_common_beginning(spark):
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")] + [(1, s, 1, "assistant", "yes") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 2, "user", "more"), (1, "chosen", 3, "assistant", "good"), (1, "rejected", 2, "user", "else"), (1, "rejected", 3, "assistant", "bad")]
    assert segments(spark, rows) == [
        (1, "chosen", 3, "user", None),
        (1, "chosen", 4, "assistant", "good<|im_end|>\n"),
        (1, "prompt", 1, "user", None),
        (1, "prompt", 2, "assistant", None),
        (1, "rejected", 3, "user", None),
        (1, "rejected", 4, "assistant", "bad<|im_end|>\n"),
    ]


def test_odd_pairs(spark):
    equal = [(1, s, 0, "user", None) for s in ("chosen", "rejected")]
    shorter = [(2, "chosen", 5, "user", "a"), (2, "rejected", 7, "user", "a"), (2, "rejected", 8, "assistant", "b"), (2, "rejected", 8, "assistant", "b")]
    one_side = [(3, "chosen", 0, None, "only")]
    ties = [(4, s, 0, "user", t) for s in ("chosen", "rejected") for t in ("y", "x")]
    out = [(None, "chosen", 0, "user", "a"), (5, "other", 0, "user", "a"), (5, "chosen", None, "user", "a")]
    assert segments(spark, equal + shorter + one_side + ties + out) == [
        (1, "prompt", 1, "user", None),
        (2, "prompt", 1, "user", None),
        (2, "rejected", 2, "assistant", "b<|im_end|>\n"),
        (3, "chosen", 1, "", None),
        (4, "prompt", 1, "user", None),
        (4, "prompt", 2, "user", None),
    ]
    assert segments(spark, out) == []


def test_role_and_text_are_told_apart(spark):
    rows = [(1, "chosen", 0, "a\nb", "c"), (1, "rejected", 0, "a", "b\nc")]
    assert [r[1:4] for r in segments(spark, rows)] == [("chosen", 1, "a\nb"), ("rejected", 1, "a")]


def test_last_replies_are_exchanged(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 2, "user", "end"), (2, 0, "user", "no reply"), (4, 0, "assistant", "alone")]
    pairs = chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("side = 'rejected'")
    assert {(r.pair_id, r.turn): r.text for r in pairs.collect()} == {(0, 0): "q", (0, 1): "b", (1, 0): "r", (1, 1): "a", (1, 2): "end", (2, 0): "no reply", (4, 0): ""}
