from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import pairwise

from eventloom.llm import repair
from eventloom.llm.queries import QUERIES
from eventloom.session import fresh_path
from tests.llm.conftest import SF


def plain_edits(turns):
    """The cheapest edits of ``(initial, fault)`` turns, first in order of letters, by trying all of them state by state."""
    best = {"": (0, "")}  # by last role written

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def following(state):
        return "a" if state == "u" else "u"

    def with_inserts(table):
        for _ in range(3):
            for state, (cost, letters) in list(table.items()):
                put(table, following(state), (cost + 3, letters + "I"))
        return table

    for initial, fault in turns:
        after = {}
        for state, (cost, letters) in with_inserts(best).items():
            put(after, state, (cost + 4, letters + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if initial == following(state) or (initial == "s" and state == ""):
                    put(after, initial, (cost + extra, letters + "K"))
                put(after, following(state), (cost + extra + 3, letters + "R"))
        best = after
    with_inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain_report(rows):
    """By conversation the whole result, from ``(conversation, turn, role, text)``."""
    out = {}
    groups = defaultdict(list)
    for conversation, turn, role, text in rows:
        said = hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + hashlib.sha256(text.encode()).hexdigest()).encode()).digest()
        groups[conversation].append((turn is not None, turn or 0, said, role, text))
    for conversation, listed in groups.items():
        listed.sort()
        seen, faults = set(), []
        for _, _, _, role, text in listed:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[3][:1] for r in listed]
        numbers = [r[1] for r in listed if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
        cost, audit = plain_edits(list(zip(initials, faults, strict=True)))
        lines, at = [], 0
        for letter in audit:
            role, text = listed[at][3:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            offset = len(lines) - bool(lines and lines[0][0].startswith("s"))
            lines.append((role if letter == "K" else ("user", "assistant")[offset % 2], text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        out[conversation] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(repaired):
    empty = hashlib.sha256().hexdigest()
    joined = repaired.report().join(repaired.digests(), "conversation", "left").collect()
    return {r.conversation: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or empty) for r in joined}


def test_auction_finds_the_first_of_the_cheapest_edits():
    random.seed(1)
    code = {"": str, "truncated": lambda i: "+" if i == "-" else i.upper(), "blank": lambda i: "x", "duplicate": lambda i: "x"}
    for n in [0, 1, 2, 3] * 40 + [9] * 200 + [40] * 20:
        turns = [(random.choice("suaua-"), random.choice(["", "", "", "truncated", "blank"])) for _ in range(n)]
        ((cost, audit, last),) = repair.auctions("".join(code[f](i) for i, f in turns), (repair.START,), repair.ENDS)
        assert (cost, audit) == plain_edits(turns)
        assert last in (repair.START, repair.ASSISTANT)


TEXTS = ["Yes.", "no", "", " \t", "What?", "Well! ", "é。", "cut\n", "More..."]


def made(seed, conversations, most):
    random.seed(seed)
    rows = []
    for c in range(conversations):
        roles = random.choice([["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["tool", "", "a", "sys"]])
        for turn in range(random.randint(1, most)):
            role = random.choice([roles[turn % len(roles)]] * 8 + ["user", " "])
            rows.append((f"c{c}", random.choice([turn] * 9 + [None, turn + 5, 3]), role, random.choice(TEXTS) if random.random() < 0.4 else f"Text {turn}."))
    return rows


def test_repair_equals_its_definition_whole_and_in_pieces(spark):
    rows = made(2, 40, 12) + made(3, 3, 150) + [("same", 4, "user", "Again.")] * 50 + [("none", None, "x", "")] * 2
    rows = list({}.fromkeys(rows)) + rows[:30] + [("same", 4, "user", "Again.")] * 50
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conversation string, turn long, role string, text string, place int, row int").repartition(6)
    expected = plain_report(rows)
    for length in (4, repair.PIECE):
        assert found(repair.Repair(turns, length)) == expected


def test_written_turns_are_numbered_and_in_order(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hello?"), ("a", 2, "user", ""), ("b", 5, "assistant", "Ok.")]
    repaired = repair.Repair(spark.createDataFrame(rows, "conversation string, turn long, role string, text string"))
    written = sorted(tuple(r) for r in repaired.written().collect())
    assert written == [
        ("a", 1, "K", "user", "Hi."), ("a", 2, "R", "assistant", "Hello?"), ("b", 1, "I", "user", ""), ("b", 2, "K", "assistant", "Ok."),
    ]


def test_odd_and_no_rows(spark):
    schema = "conversation string, turn long, role string, text string"
    none = repair.Repair(spark.createDataFrame([], schema))
    assert found(none) == {} and none.written().count() == 0
    rows = [(None, 1, "user", "Left out."), ("k", None, "user", "x" * 100_000 + "."), ("k", None, "assistant", "y.")]
    assert set(found(repair.Repair(spark.createDataFrame(rows, schema)))) == {"k"}


def plain_damage(rows):
    out = []
    for conversation, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conversation, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def test_query_on_given_and_odd_conversations(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(-1, None, None, None), (-2, 1, None, "Hi."), (-3, 0, "user", None), (None, 4, "assistant", "No id."), (None, 4, "assistant", "No id.")]
    odd += [(-4, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." * 50) for t in range(700)]
    rows = given + odd
    folder = fresh_path(spark, "odd-conversations")
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conversation string").write.parquet(f"{folder}/conversations.parquet")
    result = QUERIES["op13_conversation_repair"](spark, folder).collect()
    expected = plain_report(plain_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert len(result) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in result} == {c: expected.get(c, empty) for c in {r[0] for r in rows}}
