"""Repair of conversation structure by the cheapest edits, with an auction algorithm for shortest paths.

The turns of a conversation in order and the edits make a lattice: a node is a number of turns read and the last role
written (none, system, user, assistant); an edit is an arc with a whole cost. The auction algorithm finds the cheapest
path from the first node to an end. It holds a path from the first node and a price for each node. The last node of the
path either takes the cheapest arc on (arc cost and price of the next node), or, if that is dearer than its own price,
raises its price to it and leaves the path. Prices never exceed the cost to the end by more than they exceed it at the
end, so that the path that arrives is a cheapest one, and on every cheapest path the arcs are tight: price equals arc cost
and next price. Among tight arcs the first letter is taken; a node of the path whose price is unchanged since had no
smaller tight arc and, as prices only rise, has none now. So the path that arrives also has the first letters of all.

Long conversations are cut into pieces of ``PIECE`` turns, which tasks solve on their own: first the cost between all entry
and exit roles of a piece, then, with the prices that the pieces behind it give to its exits, the edits for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.batches import short_batches
from eventloom.session import durable

PIECE = 64  # turns that one auction sees at most
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
# Last role written: none, system, user, assistant. A conversation may end after none or the assistant.
START, SYSTEM, USER, ASSISTANT = STATES = tuple(range(4))
ENDS = (0, None, None, 0)
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
# The role that an inserted or changed turn must have next, and what may be kept.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})

# Word characters of the rules are all but ASCII white space, and a whole text ends with one of these.
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"

# A turn as one character: its role's initial (``-`` for others), upper-case if truncated, or ``x`` if it must go.


def _arcs_of(turn: str, state: int) -> list[tuple[str, int, int, int]]:
    """``(letter, cost, turns read, next state)`` from a node before ``turn``, in order of their letters; an insert reads none."""
    out = []
    if turn:
        out.append((DELETE, DELETE_COST, 1, state))
    out.append((INSERT, INSERT_COST, 0, NEXT[state]))
    if turn and turn != "x":
        extra = TRUNCATED_COST if turn.isupper() or turn == "+" else 0
        kept = KEPT[state].get(turn.lower())
        if kept is not None:
            out.append((KEEP, extra, 1, kept))
        out.append((REROLE, REROLE_COST + extra, 1, NEXT[state]))
    return out


ARCS = {(turn, state): _arcs_of(turn, state) for turn in ("", *"suaSUA-+x") for state in STATES}


def _auction(turns: str, entry: int, exits: tuple[int | None, ...], prices: dict[tuple[int, int], int]) -> tuple[int, str, int]:
    """``(cost, edits, last state)`` of the cheapest edits from one entry; raises ``prices``, which hold for any entry."""
    n = len(turns)
    done = (n + 1, 0)  # the end of all, behind the exits; its price stays 0
    path, letters = [(0, entry)], []
    price = prices.get
    while path[-1] != done:
        at, state = path[-1]
        best, step = None, None
        if at == n and exits[state] is not None:
            best, step = exits[state], ("", done)
        for letter, cost, read, after in ARCS[turns[at : at + 1], state]:
            node = (at + read, after)
            whole = cost + price(node, 0)
            if best is None or whole < best:
                best, step = whole, (letter, node)
        if best > price(path[-1], 0):
            prices[path[-1]] = best
            if len(path) > 1:
                path.pop()
                letters.pop()
        else:
            letters.append(step[0])
            path.append(step[1])
    return price((0, entry), 0), "".join(letters), path[-2][1]


@lru_cache(maxsize=50_000)
def auctions(turns: str, entries: tuple[int, ...], exits: tuple[int | None, ...]) -> list[tuple[int, str, int] | None]:
    """For each entry state ``(cost, edits, last state)`` of the cheapest edits over all turns, first in order of letters among equals.

    ``exits`` are the costs still to come by the state after the last turn; None where there is no way on from there. An
    entry without a way to any exit gets None. Prices that one entry has raised are kept for the next: they bound the cost to
    the exits from below wherever a path begins.
    """
    prices: dict[tuple[int, int], int] = {}
    ways = {leave for leave, e in enumerate(exits) if e is not None}
    out = []
    for entry in entries:
        # User and assistant can be written at any time; none and system only last through deletions, or a system turn kept first.
        reached = ways & {USER, ASSISTANT, entry} or (SYSTEM in ways and entry == START and any(t in "sS" for t in turns))
        out.append(_auction(turns, entry, exits, prices) if reached else None)
    return out


def _behind(costs: list[list[int | None]], exits: tuple[int | None, ...]) -> tuple[int | None, ...]:
    """The cost to come by entry state of a piece, from those by its exit state."""
    out = []
    for row in costs:
        ways = [c + e for c, e in zip(row, exits, strict=True) if c is not None and e is not None]
        out.append(min(ways) if ways else None)
    return tuple(out)


def _piece_costs(turns: str) -> list[int]:
    """Costs from each entry to each exit state of a piece, row by row; -1 where there is no way."""
    by_exit = [auctions(turns, STATES, tuple(0 if s == leave else None for s in STATES)) for leave in STATES]
    return [-1 if by_exit[leave][entry] is None else by_exit[leave][entry][0] for entry in STATES for leave in STATES]


def _array(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(conversation, piece, cost, audit)`` for conversations of one piece."""
    for batch in batches:
        solved = [auctions(t, (START,), ENDS)[0] for t in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conversation"), batch.column("piece"), _array([s[0] for s in solved], pa.int64()), _array([s[1] for s in solved], pa.string())],
            names=["conversation", "piece", "cost", "audit"],
        )


def _cost_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [_piece_costs(t) for t in batch.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conversation"), batch.column("piece"), _array(costs, pa.list_(pa.int64()))], names=["conversation", "piece", "costs"])


def _exit_prices(table: pa.Table) -> pa.Table:
    """The cost to come behind each piece of one conversation, by state; -1 for none."""
    table = table.sort_by([("piece", "descending")])
    exits: tuple[int | None, ...] = ENDS
    out = []
    for costs in table.column("costs").to_pylist():
        out.append([-1 if e is None else e for e in exits])
        rows = [[None if c < 0 else c for c in costs[4 * i : 4 * i + 4]] for i in range(4)]
        exits = _behind(rows, exits)
    return pa.table({"conversation": table.column("conversation"), "piece": table.column("piece"), "exits": _array(out, pa.list_(pa.int64()))})


def _trace_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry state of a piece, the edits up to its exit and the exit's state; null where there is no way."""
    for batch in batches:
        audits, leaves, costs = [], [], []
        for turns, exits in zip(batch.column("turns").to_pylist(), batch.column("exits").to_pylist(), strict=True):
            prices = tuple(None if e < 0 else e for e in exits)
            found = auctions(turns, STATES, prices)
            audits.append([None if f is None else f[1] for f in found])
            leaves.append([-1 if f is None else f[2] for f in found])
            costs.append([-1 if f is None else f[0] for f in found])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conversation"),
                batch.column("piece"),
                _array(audits, pa.list_(pa.string())),
                _array(leaves, pa.list_(pa.int32())),
                _array(costs, pa.list_(pa.int64())),
            ],
            names=["conversation", "piece", "audits", "leaves", "costs"],
        )


def _entries(table: pa.Table) -> pa.Table:
    """The entry state of each piece of one conversation, and the whole cost beside its first piece."""
    table = table.sort_by("piece")
    state, entries, costs = START, [], []
    for i, (leaves, all_costs) in enumerate(zip(table.column("leaves").to_pylist(), table.column("costs").to_pylist(), strict=True)):
        entries.append(state)
        costs.append(all_costs[state] if i == 0 else 0)
        state = leaves[state]
    return pa.table(
        {"conversation": table.column("conversation"), "piece": table.column("piece"), "entry": _array(entries, pa.int32()), "cost": _array(costs, pa.int64())}
    )


def _cheapest_edits(pieces: DataFrame) -> DataFrame:
    """``(conversation, piece, cost, audit)`` from ``(conversation, piece, turns)``; the costs of a conversation add up to its whole cost."""
    spans = pieces.groupBy("conversation").agg(F.count("*").alias("pieces"))
    known = durable(pieces.join(spans, "conversation"))
    single = known.where("pieces = 1").select("conversation", "piece", "turns")
    solved = single.mapInArrow(_solve_whole, "conversation string, piece long, cost long, audit string")
    # Their rows are short and their work is not, so they are dealt to as many tasks as the session has for a shuffle.
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = known.where("pieces > 1").select("conversation", "piece", "turns").repartition(tasks, "conversation", "piece")
    costs = several.mapInArrow(_cost_tables, "conversation string, piece long, costs array<long>")
    # A piece is a few numbers here, so one task can chain all those of a conversation.
    exits = costs.groupBy("conversation").applyInArrow(_exit_prices, "conversation string, piece long, exits array<long>")
    traced = several.join(exits, ["conversation", "piece"]).mapInArrow(
        _trace_entries, "conversation string, piece long, audits array<string>, leaves array<int>, costs array<long>"
    )
    traced = durable(traced)
    entries = traced.select("conversation", "piece", "leaves", "costs").groupBy("conversation")
    entries = entries.applyInArrow(_entries, "conversation string, piece long, entry int, cost long")
    chained = traced.select("conversation", "piece", "audits").join(entries, ["conversation", "piece"])
    return solved.unionByName(chained.select("conversation", "piece", "cost", F.col("audits")[F.col("entry")].alias("audit")))


def ordered_turns(numbered: DataFrame) -> DataFrame:
    """``(conversation, place, row, turn, initial, fault, code)`` of ``numbered(conversation, turn, role, text, row)``, written once.

    ``place`` numbers all rows by conversation, turn (nulls first) and a hash of role and text. Rows are dealt by range and
    without their texts, so that a conversation of any length is shared by tasks; ``row`` also parts equal rows.
    """
    said = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256))
    shown = F.rtrim("text", F.lit(BLANKS))
    cut = ~F.substring(shown, -1, 1).isin(list(SENTENCE_ENDS))
    thin = numbered.select(
        "conversation", "turn", said.alias("said"), "row", F.substring("role", 1, 1).alias("initial"), (shown == "").alias("blank"), cut.alias("cut")
    )
    order = ["conversation", "turn", "said", "row"]
    dealt = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(dealt.withColumn("place", F.monotonically_increasing_id()))
    # A row is a duplicate unless it is the first that says this; minima find that one, not a window over all copies.
    firsts = placed.groupBy("conversation", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut"), "truncated").alias("fault")
    rows = placed.join(firsts, "place", "left").select("conversation", "place", "row", "turn", "initial", fault)
    usual = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.translate(F.upper(usual), "-", "+")).otherwise(usual)
    return durable(rows.withColumn("code", code))


def _piece(length: int) -> Column:
    """Which run of so many places, a power of two, a row is in."""
    return F.shiftright("place", length.bit_length() - 1).alias("piece")


def _in_pieces(rows: DataFrame, length: int) -> DataFrame:
    """``(conversation, piece, turns, places, rows)``: the codes of up to ``length`` neighbouring rows of a conversation as one string."""
    piece = _piece(length)
    listed = F.sort_array(F.collect_list(F.struct("place", "row", "code"))).alias("codes")
    codes = rows.select("conversation", "place", "row", "code", piece).groupBy("conversation", "piece").agg(listed)
    columns = F.array_join(F.col("codes.code"), "").alias("turns"), F.col("codes.place").alias("places"), F.col("codes.row").alias("rows")
    return codes.select("conversation", "piece", *columns)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written turns of rows that come sorted by (conversation, place), each with the edits up to it."""
    conversation, state, position = None, START, 0
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("conversation", "role", "text", "edits"))
        for own, role, text, edits in zip(*columns, strict=True):
            if own != conversation:
                conversation, state, position = own, START, 0
            for letter in edits:
                if letter == DELETE:
                    continue
                state = KEPT[state][role[0]] if letter == KEEP else NEXT[state]
                position += 1
                out.append((own, position, letter, role if letter == KEEP else WRITTEN[state], "" if letter == INSERT else text))
        columns = zip(*out, strict=True) if out else ([] for _ in range(5))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([_array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conversation", "position", "edit", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 over the written ``role:text`` lines of each conversation; only the digest of one is held at a time."""
    conversation, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array([conversation], pa.string()), _array([digest.hexdigest()], pa.string())], names=["conversation", "sha256"])

    for batch in batches:
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conversation", "role", "text")), strict=True):
            if own != conversation:
                if digest is not None:
                    yield row()
                conversation, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield row()


class Repair:
    """The repaired conversations of ``turns(conversation, turn, role, text)``, and what was wrong with them.

    Roles that begin with s, u or a are known by that initial. A repaired conversation is empty, or turns of user and
    assistant in exchange, after at most one of the system and ending with the assistant. To keep a turn is free, to change
    its role to user or assistant costs 3, to delete it 4, to insert an empty turn 3; a truncated turn that stays costs 3
    more. Blank turns and those that repeat an earlier role and text must go. Of equally cheap edits those whose letters
    (D, I, K, R) come first are taken.

    All texts and roles must be given; a null conversation is no conversation and its rows are left out. A null turn
    comes before all others. Turns of one number are in order of a hash of role and
    text, equal rows side by side.
    Other columns are ignored, and an empty table gives no rows.
    """

    def __init__(self, turns: DataFrame, length: int = PIECE):
        self.length = length
        short_batches(turns.sparkSession)
        known = turns.where(F.col("conversation").isNotNull())
        columns = F.col("conversation").cast("string").alias("conversation"), F.col("turn").cast("long").alias("turn"), "role", "text"
        self.texts = durable(known.select(*columns, F.monotonically_increasing_id().alias("row")))
        self.rows = ordered_turns(self.texts)
        self.pieces = durable(_in_pieces(self.rows, length))
        self.edits = durable(_cheapest_edits(self.pieces.select("conversation", "piece", "turns")))

    def written(self) -> DataFrame:
        """``(conversation, position, edit, role, text)`` of the turns of all repaired conversations, from 1; rows of one are side by side."""
        # The edits of a piece, cut after the edit that reads a turn; inserts at its end go with the last turn.
        split = F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
        each = self.edits.join(self.pieces.select("conversation", "piece", "places", "rows"), ["conversation", "piece"])
        each = each.select(F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("rows").alias("row"), split.alias("edits"))).alias("e"))
        rows = self.texts.select("row", "conversation", "role", "text").join(each.select("e.*"), "row")
        # One task writes a conversation, turn by turn, as its digest is made of all before; no conversation is held.
        rows = rows.repartition("conversation").sortWithinPartitions("conversation", "place")
        return rows.mapInArrow(_lines, "conversation string, position long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """``(conversation, sha256)`` over the ``role:text`` lines of each repaired conversation that has any."""
        return self.written().mapInArrow(_digests, "conversation string, sha256 string")

    def report(self) -> DataFrame:
        """``(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row for each conversation with rows.

        ``gaps`` counts missing turn numbers between the first and the last; ``illegal`` neighbours whose initials are not su, ua or au.
        """
        marked = self.rows.select("conversation", "turn", "place", "fault", "initial")
        sums = marked.groupBy("conversation").agg(
            F.max("turn").alias("high"),
            F.min("turn").alias("low"),
            *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        )
        numbers = marked.where("turn is not null").select("conversation", "turn").distinct().groupBy("conversation").agg(F.count("*").alias("numbers"))
        # Neighbours within a piece are read off its rows; between pieces, off the first and last rows.
        of_piece = marked.select("conversation", "place", "initial", _piece(self.length)).groupBy("conversation", "piece")
        of_piece = of_piece.agg(F.sort_array(F.collect_list(F.struct("place", "initial"))).alias("rows"))
        inits = F.col("rows.initial")
        legal = ["su", "ua", "au"]
        pairs = F.zip_with(F.slice(inits, F.lit(1), F.size(inits) - 1), F.slice(inits, F.lit(2), F.size(inits)), lambda a, b: F.concat(a, b))
        of_piece = of_piece.select(
            "conversation", "piece", inits[0].alias("first"), F.element_at(inits, -1).alias("last"), F.size(F.filter(pairs, lambda p: ~p.isin(legal))).cast("long").alias("inside")
        )
        inside = of_piece.groupBy("conversation").agg(
            F.sum("inside").alias("inside"), F.sort_array(F.collect_list(F.struct("piece", "first", "last"))).alias("ends")
        )
        ends = F.zip_with(F.slice(F.col("ends.last"), F.lit(1), F.size("ends") - 1), F.slice(F.col("ends.first"), F.lit(2), F.size("ends")), lambda a, b: F.concat(a, b))
        illegal = F.col("inside") + F.size(F.filter(ends, lambda p: ~p.isin(legal)))
        audits = self.edits.groupBy("conversation").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("audits"))
        joined = sums.join(numbers, "conversation", "left").join(inside.select("conversation", illegal.alias("illegal")), "conversation").join(audits, "conversation")
        return joined.select(
            "conversation",
            F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)).alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            "illegal",
            "cost",
            F.array_join(F.col("audits.audit"), "").alias("audit"),
        )


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conversation, turn, role, text)`` with faults put in by crc32 of ``conv_id:turn``: of 20 rows one each is dropped,
    emptied, stripped of sentence ends, repeated, and given the role user. Nulls are read as one space, but for the turn itself."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(plain("conv_id").alias("conversation"), "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
