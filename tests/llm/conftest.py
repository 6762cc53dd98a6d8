from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny(spark):
    """Documents with every odd case: nulls, empty and blank texts, copies, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "b"),
        (6, "one", "b"),
        (7, "naïve Ünïcode — 日本語 text\nwith lines and blanks", "b"),
        (8, long_text, "a"),
        (None, "a row without an id but with quite a few words in it", None),
        (9, long_text + " end", "c"),
    ]
    full = [(i, t, s, "x", 1, 2, 3, "y") for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, id string, fingerprint int, component int, score int, print string")


def empty(table):
    return table.where("false")
