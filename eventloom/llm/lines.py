"""Fuzzy line dedup: DataFrame functions only.

1. Each line becomes its lower-case words between white space; equal word sequences are one line with many occurrences.
2. Each line gets a SimHash of its distinct words. Of five blocks of the hash, two are equal in any two
   hashes that differ in up to three bits; the ten pairs of blocks are join keys.
3. Lines that share a key, differ in up to three bits and are similar in words by edit distance link.
   First each line is compared with the smallest line of each of its keys. What that leaves apart is compared
   with all lines of the key that are not yet connected to it, so a dense group is never spelled out as pairs.
4. Of each connected group the first occurrence stays.

With ``every_pair`` the hash and its bits do not matter: all lines that are similar by edit distance link.
One edit of a word changes at most q of a line's runs of q words, so similar lines share one of
their first runs in one order (see ``shared_keys``), and those are the join keys of step 2. That run also stands
at places that so few edits can bring together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm import shared_keys
from eventloom.llm.components import connected_components
from eventloom.session import durable, passing_folder, written

MOST_BITS = 3
SIMILARITY = 0.8
LEAST_WORDS = 3  # distinct words; lines with fewer are left alone
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, bits
BROADCAST_ROWS = 200_000  # of three numbers each, and as many in their lists; longer ones are joined by shuffle
PART_PAIRS = 500_000  # that get their words at a time, if they are taken in parts
# Words of a run, and the numbers of words of a line for which such runs are keys. Similar lines are both within one range.
RUNS = ((2, 4, 6), (3, 6, (1 << 31) - 1))
RUN_KEY_BITS = 40  # of a run's hash; what meets by chance is compared and found different
FREQUENT_LONGS = 16_384  # 64 bits each, one for each hash of runs; set for frequent ones
# 128 groups of words by hash, in two numbers for each of: those that a line has at all, at least twice, and so on.
TIMES = 3
MARK_COLUMNS = tuple(f"bits_{times}_{half}" for times in range(TIMES) for half in range(2))

# 256 groups in four numbers each, of those that a line has at all, at least twice and three times; and by their last six bits
# in a number for each of LEVELS, where one of them is in the line at least so many times.
FINE_GROUPS = 256
LEVELS = tuple(1 << power for power in range(2, 13))
FINE_COLUMNS = tuple(f"fine_{quarter}_{times}" for quarter in range(4) for times in range(1, TIMES + 1))
LEVEL_COLUMNS = tuple(f"level_{least}" for least in LEVELS)


def line_words(line: Column) -> Column:
    """Lower-case words between white space of any kind."""
    return F.array_remove(F.split(F.lower(line), r"(?U)\s+"), "")


# Marks that are no words when they stand alone.
MARKS = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
LANE_BITS, LANES = 21, 3
TOP = LANE_BITS - 1
ONES = sum(1 << (LANE_BITS * lane) for lane in range(LANES))  # a one in each lane
MOST_WORDS = (1 << TOP) - 1  # that lanes can count; lines of more words get the same sums bit by bit


def _lane_sums(word_hash: str) -> list[Column]:
    """Counts of the 64 bits of many hashes: each long has three of them, side by side."""
    sums = [F.sum(F.shiftrightunsigned(word_hash, s).bitwiseAND(F.lit(ONES))).alias(f"lanes_{s}") for s in range(LANE_BITS)]
    return [*sums, F.sum(F.shiftrightunsigned(word_hash, 63)).alias(f"lanes_{LANE_BITS}")]


def _majority(total: str) -> Column:
    """64 bits, each set where over half of ``total`` hashes have it.

    A lane's highest bit is set by adding what lacks from half of the hashes to
    that bit, in all three lanes at once.
    """
    lacking = (F.lit(MOST_WORDS) - F.floor(F.col(total) / 2)) * ONES
    out = F.shiftleft((F.col(f"lanes_{LANE_BITS}") * 2 > F.col(total)).cast("long"), 63)
    for s in range(LANE_BITS):
        over = F.shiftrightunsigned(F.col(f"lanes_{s}") + lacking, TOP).bitwiseAND(F.lit(ONES))
        out = out.bitwiseOR(F.shiftleft(over, s))
    return out


def _plain_majority(total: str) -> Column:
    """The same from a count for each bit, whatever the number of hashes."""
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.shiftleft((F.col(f"bit_{b}") * 2 > F.col(total)).cast("long"), b))
    return out


def add_simhash(lines: DataFrame, *keys: str, longest: bool = False) -> DataFrame:
    """``(keys, a, n, simhash)`` for lines of ``(keys, words)`` with at least LEAST_WORDS distinct words.

    ``a`` is a hash of all words and marks and ``n`` their number; the SimHash is that
    of the distinct words, without marks that stand alone, else a few frequent
    words would make most lines alike. Words are rows that are added up where
    they are read; only sums are shuffled. Lines of over MOST_WORDS words are left out,
    or with ``longest`` are the only ones; their hashes are the same sums, taken bit by bit.
    """
    size = F.size("words")
    sized = size > MOST_WORDS if longest else size.between(LEAST_WORDS, MOST_WORDS)
    hashed = lines.where(sized).select(*keys, F.xxhash64("words").alias("a"), size.cast("long").alias("n"), "words")
    rows = hashed.select(*keys, "a", "n", F.explode(F.array_distinct("words")).alias("word"))
    rows = rows.where(~F.col("word").isin(MARKS)).select(*keys, "a", "n", F.xxhash64("word").alias("h"))
    counts = [F.min("a").alias("a"), F.min("n").alias("n"), F.count("*").alias("distinct")]
    bits = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"bit_{b}") for b in range(64)] if longest else _lane_sums("h")
    summed = rows.groupBy(*keys).agg(*counts, *bits).where(F.col("distinct") >= LEAST_WORDS)
    return summed.select(*keys, "a", "n", (_plain_majority if longest else _majority)("distinct").alias("simhash"))


def _block_keys(simhash: Column) -> Column:
    blocks = [F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in BLOCKS]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks))]
    return F.array(*[F.shiftleft(blocks[i], 13).bitwiseOR(blocks[j]).bitwiseOR(F.lit(n << 26)) for n, (i, j) in enumerate(pairs)])


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _close(a: str, b: str) -> Column:
    """Numbers of words that allow the similarity at all."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY


def _word_string(words: Column) -> Column:
    """One character for each word, by its hash among a million code points, so that edits of words can be counted."""
    codes = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xFFFF0)) + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def _word_bits(words: Column) -> Column:
    """MARK_COLUMNS of a line in a struct; words that occur again count again."""
    nothing = F.lit(0).cast("long")

    def half(groups: Column, high: int) -> Column:
        def bit(g: Column) -> Column:
            return F.when(F.shiftright(g, 6) == high, F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(F.lit(63)))).otherwise(nothing)

        return F.aggregate(groups, nothing, lambda bits, g: bits.bitwiseOR(bit(g)))

    def marks(groups: Column, times: int) -> Column:
        """Those of sorted groups, and then of what is left without the first of each."""
        own = [half(groups, high).alias(f"bits_{times}_{high}") for high in range(2)]
        if times == TIMES - 1:
            return F.struct(*own)
        again = F.filter(groups, lambda g, i: F.get(groups, i - 1) == g)
        rest = F.transform(F.array(again), lambda left: marks(left, times + 1))[0]
        return F.struct(*own, *[rest[c].alias(c) for c in MARK_COLUMNS[2 * (times + 1) :]])

    groups = F.sort_array(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(127)).cast("int")))
    # Through an array of one, so that groups are sorted once and not for each use of them.
    return F.transform(F.array(groups), lambda g: marks(g, 0))[0]


def _may_be_similar(own: str, other: str) -> Column:
    """One edit takes at most one word away and adds at most one, so that each line lacks at most as many bits of the other's as edits are allowed."""

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}{c}")))) for c in MARK_COLUMNS), F.lit(0))

    longest = F.greatest(f"{own}n", f"{other}n")
    return (lacking(own, other) * 5 <= longest) & (lacking(other, own) * 5 <= longest)


def _word_levels(words: Column) -> Column:
    """FINE_COLUMNS and LEVEL_COLUMNS of a line as one array of numbers."""
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def counted(g: Column) -> Column:
        """Sorted groups, each once with its number."""
        starts = F.array_compact(F.transform(g, lambda x, i: F.when(~F.get(g, i - 1).eqNullSafe(x), i)))

        def ended(at: Column) -> Column:
            return F.transform(at, lambda p, i: F.struct(g[p].alias("group"), (F.coalesce(F.get(at, i + 1), F.size(g)) - p).alias("times")))

        return F.transform(F.array(starts), ended)[0]

    def bits(found: Column, least: int) -> Column:
        def bit(f: Column) -> Column:
            return F.when(f["times"] >= least, F.call_function("shiftleft", one, f["group"].bitwiseAND(F.lit(63)))).otherwise(nothing)

        return F.aggregate(found, nothing, lambda total, f: total.bitwiseOR(bit(f)))

    def in_quarter(quarter: int):
        return lambda f: F.shiftright(f["group"], 6) == quarter

    def levels(found: Column) -> Column:
        quarters = F.array(*[F.filter(found, in_quarter(quarter)) for quarter in range(4)])
        fine = F.flatten(F.transform(quarters, lambda f: F.array(*[bits(f, times) for times in range(1, TIMES + 1)])))
        often = F.array(F.filter(found, lambda f: f["times"] >= LEVELS[0]))
        return F.concat(fine, F.transform(often, lambda f: F.array(*[bits(f, least) for least in LEVELS]))[0])

    groups = F.sort_array(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(FINE_GROUPS - 1)).cast("int")))
    # Each step through an array of one, so that it is done once and not for each use of it.
    return reduce(lambda column, step: F.transform(F.array(column), step)[0], [counted, levels], groups)


def _levels_allow(own: str, other: str, size: str) -> Column:
    """Each edit takes at most one word away and adds at most one, so that words that a line has more of are no more than the edits.

    A group at one of LEVELS, that the other line has fewer times than the level before, has as many words more as lie between the two.
    """

    def lacking(x: str, y: str, pairs) -> Column:
        return sum((F.bit_count(F.col(f"{x}{a}").bitwiseAND(F.bitwise_not(F.col(f"{y}{b}")))) * more for a, b, more in pairs), F.lit(0))

    fine = [(c, c, 1) for c in FINE_COLUMNS]
    steps = zip(LEVEL_COLUMNS[1:], LEVEL_COLUMNS, LEVELS[1:], LEVELS, strict=False)
    often = [(LEVEL_COLUMNS[0], LEVEL_COLUMNS[0], 1), *[(c, before, least - less) for c, before, least, less in steps]]
    longest = F.greatest(f"{own}{size}", f"{other}{size}")
    allowed = [lacking(x, y, pairs) * 5 <= longest for pairs in (fine, often) for x, y in ((own, other), (other, own))]
    return reduce(Column.__and__, allowed)


def _bounded(places: DataFrame) -> DataFrame:
    """Marked for broadcast if counted and short, with all that its lists hold; otherwise its rows are held and what it meets is not sorted."""
    size = places.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    return F.broadcast(places) if max(size) <= BROADCAST_ROWS else places.hint("shuffle_hash")


def _occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, copy, line, words)`` for each line to compare; copy is a hash of its text."""
    text = F.col(f"`{text_column}`").cast("string")
    lines = docs.where(F.col(f"`{id_column}`").isNotNull() & text.isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content")
    )
    # Out of an array of one, so that words are cut once and not for each use of them.
    return lines.select("id", "copy", "line", F.explode(F.array(line_words(F.col("content")))).alias("words"))


def _words_of(wanted: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(a, words)`` of lines ``(a, id, line, copy)``, read from the texts again."""
    places = durable(wanted.groupBy("id", "copy").agg(F.collect_list(F.struct("line", "a")).alias("places")))
    text = F.col(f"`{text_column}`").cast("string")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"))
    found = texts.join(_bounded(places), "id").where(F.xxhash64("text") == F.col("copy"))
    # The text is cut into lines once, and its wanted lines become rows.
    found = found.select("places", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    found = found.select(F.explode(F.transform("places", lambda p: F.struct(p["a"].alias("a"), F.col("lines")[p["line"]].alias("line")))).alias("p"))
    return found.select("p.a", F.explode(F.array(line_words(F.col("p.line")))).alias("words"))


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, id_column: str, text_column: str, in_parts: bool = False) -> DataFrame:
    """Of ``(x, y)`` pairs of distinct lines those whose words are similar by edit distance; ``in_parts`` they get their words part by part."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("a")).distinct().join(distinct.select("a", "first.*").dropDuplicates(["a"]), "a")
    found = _words_of(wanted, docs, id_column, text_column).select("a", _word_string(F.col("words")).alias("string"))
    strings = found.groupBy("a").agg(F.min("string").alias("string"))
    if not in_parts:
        return _near(pairs, durable(strings))
    with passing_folder(docs.sparkSession, "line-words") as folder:
        strings = written(strings, folder)
        parts = min(shared_keys.PARTS, 1 + pairs.count() // PART_PAIRS)
        near = [durable(_near(pairs.where(F.pmod(F.xxhash64("x"), F.lit(parts)) == part), strings)) for part in range(parts)]
    return reduce(DataFrame.unionByName, near)


def _near(pairs: DataFrame, strings: DataFrame) -> DataFrame:
    x, y = (strings.select(F.col("a").alias(n), F.col("string").alias(f"{n}_string")) for n in ("x", "y"))
    both = pairs.join(x, "x").join(y, "y")
    most = F.floor(F.greatest(F.length("x_string"), F.length("y_string")) * (1 - SIMILARITY) + 1e-9).cast("int")
    near = F.call_function("levenshtein", F.col("x_string"), F.col("y_string"), most) >= 0  # -1 beyond the most
    return both.where(near).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _runs(words: Column, length: int) -> Column:
    """Hashes of all runs of so many words."""
    starts = F.slice(words, F.lit(1), F.size(words) - (length - 1))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[words[i + k] for k in range(1, length)]))


def _run_keys(words: Column, length: int, frequent: Column) -> Column:
    """``(key, at)`` of the first distinct runs, frequent ones last: one more than edits that leave the similarity can change.

    ``at`` is the place of the run in the line, unknown if it stands there again.
    """

    def order(h: Column) -> Column:
        at = F.pmod(h, F.lit(FREQUENT_LONGS * 64))
        last = F.getbit(frequent[F.shiftright(at, 6).cast("int")], at.bitwiseAND(F.lit(63)).cast("int")).cast("long")
        return F.shiftrightunsigned(h, 64 - RUN_KEY_BITS).bitwiseOR(F.shiftleft(last, RUN_KEY_BITS))

    def once(runs: Column) -> Column:
        def placed(run: Column, i: Column) -> Column:
            again = F.get(runs, i + 1)["key"] == run["key"]
            later = F.coalesce(F.get(runs, i - 1)["key"] == run["key"], F.lit(False))
            return F.struct(run["key"].alias("key"), F.when(again, shared_keys.UNKNOWN).otherwise(run["at"]).alias("at"), later.alias("later"))

        return F.filter(F.transform(runs, placed), lambda run: ~run["later"])

    # A fifth of the longer line's words may differ. A word put into the shorter one changes a run less than others do,
    # so that a longer partner matters only where it allows one edit more for few such words.
    fifths, left = F.floor(F.size(words) / 5).cast("int"), F.size(words) % 5
    first = fifths * length + F.greatest(F.lit(0), left - (5 - length)) + 1
    runs = F.sort_array(F.transform(_runs(words, length), lambda h, i: F.struct(order(h).alias("key"), i.alias("at"))))
    # Through an array of one, so that runs are sorted once and not for each use of them.
    return F.slice(F.transform(F.array(runs), once)[0], F.lit(1), first)


def _by_length(words: Column, keys) -> Column:
    """``keys(length)`` of all run lengths that are keys for a line of these words, in one array."""
    size = F.size(words)
    return F.flatten(F.filter(F.array(*[F.when(size.between(low, high), keys(q)) for q, low, high in RUNS]), lambda k: k.isNotNull()))


def _frequent_runs(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """Bits by hash of the runs that are frequent in a sample; which ones are set decides the order only, not what links."""
    some = _occurrences(docs.where(shared_keys.sampled(F.col(f"`{id_column}`").cast("long"))), id_column, text_column)
    bits = [0] * FREQUENT_LONGS
    for h in shared_keys.frequent(some.select(F.explode(_by_length(F.col("words"), lambda q: _runs(F.col("words"), q))).alias("run"))):
        at = h % (FREQUENT_LONGS * 64)
        bits[at >> 6] |= 1 << (at & 63)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<long>")


def _all_links(distinct: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(a, b)`` links that connect all distinct lines that are similar in words."""
    frequent = _frequent_runs(docs, id_column, text_column)
    wanted = distinct.where(F.col("n") >= RUNS[0][1]).select("a", "first.*")
    words = F.col("words")
    keyed = _words_of(wanted, docs, id_column, text_column).select(
        "a", F.size(words).alias("n"), F.explode(_by_length(words, lambda q: _run_keys(words, q, frequent))).alias("k")
    )

    def may(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
        # So many edits at least are before the run that both lines keep, and after it.
        longest, edits = F.greatest(n, other_n), F.abs(at - other_at) + F.abs((n - at) - (other_n - other_at))
        unknown = F.greatest(at, other_at) == shared_keys.UNKNOWN
        return (F.least(n, other_n) * 5 >= longest * 4) & (unknown | (edits * 5 <= longest))

    marks = distinct.select("a", "n", *MARK_COLUMNS)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (marks.select([F.col(c).alias(f"{side}{c}") for c in marks.columns]) for side in ("x_", "y_"))
        both = pairs.join(x, F.col("a") == F.col("x_a")).join(y, F.col("b") == F.col("y_a"))
        both = both.where(_may_be_similar("x_", "y_"))
        return _verified(durable(both.select(F.col("a").alias("x"), F.col("b").alias("y"))), distinct, docs, id_column, text_column, in_parts=True)

    def counted(lines: DataFrame) -> DataFrame:
        # The number of words in full: the one that goes with a key is unknown for long lines.
        found = _words_of(lines.join(distinct.select("a", "first.*"), "a"), docs, id_column, text_column)
        levels = found.select("a", F.size("words").alias("size"), F.explode(F.array(_word_levels(F.col("words")))).alias("levels"))
        columns = [F.col("levels")[i].alias(c) for i, c in enumerate((*FINE_COLUMNS, *LEVEL_COLUMNS))]
        return levels.select("a", "size", *columns).dropDuplicates(["a"])

    def alike(own: str, other: str) -> Column:
        close = F.least(f"{own}size", f"{other}size") * 5 >= F.greatest(f"{own}size", f"{other}size") * 4
        return close & _levels_allow(own, other, "size")

    return shared_keys.links_by_keys(keyed.select("k.key", "a", "n", F.col("k.at").alias("rank")), may, verified, counted, alike)


def _line_links(distinct: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(a, b)`` links that connect all distinct lines that are near in bits and in words."""
    keyed = distinct.select("a", "simhash", F.explode(_block_keys(F.col("simhash"))).alias("key"))
    same = Window.partitionBy("key")
    shared = keyed.select("*", F.count("*").over(same).alias("rows"), F.min(F.struct("a", "simhash")).over(same).alias("least"))
    shared = shared.select("key", "a", "simhash", "rows", F.col("least.a").alias("least"), F.col("least.simhash").alias("other"))
    near = (F.col("a") != F.col("least")) & (_apart("simhash", "other") <= MOST_BITS)
    # Where two lines share a key, that pair is all there is to compare.
    shared = durable(shared.select("key", "a", "simhash", "rows", "least", near.alias("near")).where("near or rows > 2"))
    first = durable(shared.where("near").select(F.col("a").alias("x"), F.col("least").alias("y")).distinct())
    links = durable(_verified(first, distinct, docs, id_column, text_column))

    groups = connected_components(links).withColumnRenamed("node", "a")
    placed = shared.where("a <> least and rows > 2").join(groups, "a", "left")
    placed = placed.select("key", "a", "simhash", F.coalesce("component", "a").alias("group"))
    mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    placed = durable(placed.join(mixed, "key").join(distinct.select("a", "n"), "a"))
    other = placed.select("key", *[F.col(c).alias(f"other_{c}") for c in ("a", "simhash", "n", "group")])
    rest = placed.join(other, "key").where(
        (F.col("group") < F.col("other_group")) & (_apart("simhash", "other_simhash") <= MOST_BITS) & _close("n", "other_n")
    )
    rest = durable(rest.select(F.col("a").alias("x"), F.col("other_a").alias("y")).distinct())
    if rest.isEmpty():
        return links
    return links.unionByName(_verified(rest, distinct, docs, id_column, text_column))


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every_pair: bool = False) -> DataFrame:
    """``(id, copy, dropped)``: numbers of the lines that occur before, exactly or nearly, in rows that have such."""
    if not every_pair:
        return durable(_dropped(_hashed(docs, id_column, text_column), docs, id_column, text_column))
    # All pairs need several times the room of the lines; none of it is kept longer than it is read.
    with passing_folder(docs.sparkSession, "line-dedup") as folder:
        columns = F.xxhash64("words").alias("a"), F.size("words").cast("long").alias("n"), F.lit(0).cast("long").alias("simhash")
        seen = _occurrences(docs, id_column, text_column).where(F.size("words") > 0)
        seen = seen.select("id", "copy", "line", *columns, F.explode(F.array(_word_bits(F.col("words")))).alias("marks"))
        seen = written(seen.select("*", "marks.*").drop("marks"), folder)
        return durable(_dropped(seen, docs, id_column, text_column, folder))


def _hashed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, copy, line, a, n, simhash)`` of all lines with enough distinct words."""
    hashed = add_simhash(_occurrences(docs, id_column, text_column), "id", "copy", "line")
    text = F.col(f"`{text_column}`").cast("string")
    # A line of so many words has at least as many characters, and as many blanks; most tables have no such text.
    if not (giants := docs.where(F.length(text) > 2 * MOST_WORDS)).isEmpty():
        hashed = hashed.unionByName(add_simhash(_occurrences(giants, id_column, text_column), "id", "copy", "line", longest=True))
    return durable(hashed)


def _dropped(seen: DataFrame, docs: DataFrame, id_column: str, text_column: str, folder: str | None = None) -> DataFrame:
    """The list of ``dropped_lines`` from all lines; with a folder, which takes what is written on the way, all pairs link."""
    bits = [F.min(c).alias(c) for c in MARK_COLUMNS if folder]  # those of all its rows
    distinct = seen.groupBy("a", "simhash").agg(F.min(F.struct("id", "line", "copy")).alias("first"), F.max("n").alias("n"), F.count("*").alias("rows"), *bits)
    distinct = written(distinct, folder) if folder else durable(distinct)
    links = (_all_links if folder else _line_links)(distinct, docs, id_column, text_column)
    groups = connected_components(links).withColumnRenamed("node", "a")
    named = distinct.join(groups, "a", "left").select("a", "simhash", "first", "rows", "component")
    kept = named.where("component is not null").groupBy("component").agg(F.min("first").alias("kept"))
    # Only lines that occur again, or are like another, can have something to drop.
    named = named.where("rows > 1 or component is not null").join(kept, "component", "left")
    named = durable(named.select("a", "simhash", F.coalesce("kept", "first").alias("kept")))
    again = seen.drop(*MARK_COLUMNS).join(named, ["a", "simhash"]).where(F.struct("id", "line", "copy") != F.col("kept"))
    return again.groupBy("id", "copy").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", dropped_column: str = "dropped", every_pair: bool = False
) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without repeated lines, and ``dropped``, the numbers of those lines.

    A line is what stands between line feeds. Lines of fewer than LEAST_WORDS
    distinct words stay, unless ``every_pair``. The first occurrence, by id and then place, of each group of
    equal or similar lines stays. Null texts stay null, empty ones empty; a row
    without an id stays as it is and its lines match none. Repeated rows are
    one place: each keeps the same lines. Other columns pass through, but for one
    with the name of ``dropped_column``; an empty table gives no rows.

    With ``every_pair`` lines are similar by edit distance of words alone, all such pairs are
    found, and lines of any number of words go when they occur again, but blank ones;
    without, SimHashes must also be within MOST_BITS.
    """
    gone = dropped_lines(docs, id_column, text_column, every_pair)
    names = [c for c in docs.columns if c != dropped_column]
    text = F.col(f"`{text_column}`").cast("string")
    # The row in one struct, so that none of its names can meet those used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        text.alias("text"),
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.xxhash64(text).alias("copy"),
    )
    # A short list goes to the texts; otherwise texts and list meet, without sorting the texts.
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("dropped") + 4), F.lit(0))).first()
    gone = F.broadcast(gone) if max(size) <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    joined = rows.join(gone, ["id", "copy"], "left")
    joined = joined.select("row", "text", "dropped", F.explode(F.array(F.when(F.col("dropped").isNotNull(), F.split("text", "\n", -1)))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    new_text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    columns = [new_text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in names]
    return joined.select(*columns, F.coalesce("dropped", F.array().cast("array<int>")).alias(dropped_column))
