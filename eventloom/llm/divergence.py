"""Source divergence audit: how far the term frequencies of each source lie from the other sources and from its language.

1. Tasks count terms of whole texts by (lang, source, term), with the number of rows that hold them; Spark adds these up.
2. Each language keeps the terms of at least ``LEAST_DOCUMENTS`` rows. All chances are whole billionths, so results are exact.
3. Pairs of sources: the kept terms of a language are dealt into blocks. A block meets tiles of sources as a dense table of
   chances, and gives one partial sum for each pair; partial sums are added up.
4. Terms of a source: a term's value rises with its count in the source and falls with its count in the language. A term
   that k others dominate (count there not lower, count in the language not higher, earlier in UTF-8) is therefore not
   among the k first. Partitions keep the terms dominated by fewer than k others, such skybands are merged in a second
   round, and only what is left gets exact values and ranks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.batches import short_batches
from eventloom.session import durable

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
BILLION = 1_000_000_000
HELD_TERMS = 500_000  # counts that a task holds before it hands them on
DOCUMENT_BITS = 40  # a held number is the occurrences below these bits and the rows with the term above; handed on long before either is full
ONE_DOCUMENT = 1 << DOCUMENT_BITS
GROUP_ROWS = 200_000  # groups of (lang, source) that are broadcast if counted to be no more
TERM_BLOCK = 8192  # kept terms of one block, on average
SOURCE_TILE = 128  # sources of one tile; a task holds two tiles of one block
MERGED = 64  # partitions whose skybands meet in one task of the second round

# Term bytes stay, with A-Z lower-cased; all others separate terms. Bytes from 128 on are parts of characters beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, documents long"
_BAND = "lang string, source string, term string, n long, lang_n long, p long, q long"


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII, with only A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by (lang, source, term); each group also once without a term, so that none is lost."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])
    counts: dict[tuple[str, str], dict[bytes, int]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), sums in counts.items():
            both = np.fromiter(sums.values(), np.int64, len(sums))
            terms = pa.array(sums.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang]).take(pa.array(np.zeros(len(sums), np.int64))), pa.array([source]).take(pa.array(np.zeros(len(sums), np.int64))), terms]
            columns += [pa.array(both & (ONE_DOCUMENT - 1)), pa.array(both >> DOCUMENT_BITS)]
            yield from pa.table(columns, schema=schema).to_batches(max_chunksize=20_000)
            yield pa.RecordBatch.from_pylist([{"lang": lang, "source": source, "term": None, "n": 0, "documents": 0}], schema)
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            sums = counts.setdefault((lang, source), {})
            held -= len(sums)
            before = sums.get
            for term, n in Counter(terms_of(text)).items():
                sums[term] = before(term, 0) + n + ONE_DOCUMENT
            held += len(sums)
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def _chance(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (total + 2 kept))`` in whole numbers of any size."""
    over = (n + 2).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + kept.cast("decimal(19,0)") * F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", over, under) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _skyband(n: np.ndarray, lang_n: np.ndarray, terms: pa.Array, k: int) -> np.ndarray:
    """Places of the terms dominated by fewer than ``k`` others, for one group of distinct terms."""
    rank = np.empty(len(n), np.int64)
    rank[pc.sort_indices(terms.cast(pa.large_binary())).to_numpy()] = np.arange(len(n))
    order = np.lexsort((rank, lang_n, -n))  # whatever dominates a term comes before it
    n, lang_n, rank = n[order], lang_n[order], rank[order]
    # Of equal counts only the k earliest can stay.
    starts = np.r_[True, (n[1:] != n[:-1]) | (lang_n[1:] != lang_n[:-1])]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(n)), 0))
    near = np.flatnonzero(np.arange(len(n)) - first < k)
    kept_lang, kept_rank = np.empty(len(near), np.int64), np.empty(len(near), np.int64)
    kept: list[int] = []
    # A term with k dominators also has k among those kept: a dominator that is left out has k of its own.
    for i in near:
        m = len(kept)
        if np.count_nonzero((kept_lang[:m] <= lang_n[i]) & (kept_rank[:m] < rank[i])) < k:
            kept_lang[m], kept_rank[m] = lang_n[i], rank[i]
            kept.append(i)
    return order[kept]


def _partition_skybands(k: int):
    """For all rows of a partition: the skyband of each group among rows held together, again when they grow."""

    def bands(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        key = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("lang", "source")], ["lang", "source"])
        codes = pc.rank(key.field(0), tiebreaker="dense").to_numpy() * np.int64(table.num_rows + 1) + pc.rank(key.field(1), tiebreaker="dense").to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.flatnonzero(np.r_[np.diff(codes[order]) != 0, True]) + 1
        n, lang_n = table.column("n").to_numpy(), table.column("lang_n").to_numpy()
        terms = table.column("term").combine_chunks()
        kept = []
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            rows = order[start:end]
            kept.append(rows[_skyband(n[rows], lang_n[rows], terms.take(pa.array(rows)), k)])
        return table.take(pa.array(np.concatenate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, HELD_TERMS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > limit:
                small = bands(pa.Table.from_batches(held).combine_chunks())
                held, rows = small.to_batches(), small.num_rows
                limit = max(HELD_TERMS, 2 * rows)
        if held:
            yield from bands(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def _tile_sums(source_tile: int, rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Partial sums over one block of terms for all pairs of sources of two tiles, smaller number first.

    ``sources(number, at_zero, tile, other_tile)`` lists the sources of both tiles; ``rows(number, term, p)`` has the terms
    that occur in them. ``at_zero`` is a source's chance of a term that it lacks.
    """
    numbers = sources.column("number").to_numpy()
    order = np.argsort(numbers)
    numbers, at_zero = numbers[order], sources.column("at_zero").to_numpy()[order]
    tile, other = (sources.column(c)[0].as_py() for c in ("tile", "other_tile"))
    terms = rows.column("term").combine_chunks().dictionary_encode()
    # Terms that none of these sources has count as well: each with every source's chance at zero.
    absent = sources.column("block_terms")[0].as_py() - len(terms.dictionary)
    p = np.repeat(at_zero[:, None], len(terms.dictionary), axis=1)
    p[np.searchsorted(numbers, rows.column("number").to_numpy()), terms.indices.to_numpy()] = rows.column("p").to_numpy()
    mine, theirs = np.flatnonzero(numbers // source_tile == tile), np.flatnonzero(numbers // source_tile == other)
    out: list[tuple[int, int, int]] = []

    def value(a, b):
        return (a - b) ** 2 // (a + b)

    for i in mine:
        with_whom = theirs[theirs > i]
        if len(with_whom):
            sums = value(p[with_whom], p[i]).sum(axis=1) + absent * value(at_zero[with_whom], at_zero[i])
            out += zip([int(numbers[i])] * len(with_whom), numbers[with_whom].tolist(), sums.tolist(), strict=True)
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    lang = sources.column("lang")[0].as_py()
    return pa.table(
        [pa.array([lang] * len(out), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
        names=["lang", "a", "b", "value"],
    )


def _pairs(kept: DataFrame, groups: DataFrame, source_tile: int) -> DataFrame:
    """``(lang, source, item, value)`` for each source and each other source of its language."""

    def meeting(table: DataFrame) -> DataFrame:
        """Each row once for every pair of tiles that its tile takes part in."""
        others = table.withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        columns = [c for c in table.columns if c not in ("tiles", "tile")]
        return others.select(*columns, F.least("tile", "one").alias("tile"), F.greatest("tile", "one").alias("other_tile"))

    rows = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    sizes = rows.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    rows = meeting(rows.select("lang", "block", "number", "term", "p", "tiles", "tile"))
    at_zero = F.when(F.col("kept") > 0, _chance(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    present = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    present = meeting(present.select("lang", "block", "number", at_zero.alias("at_zero"), "tiles", "tile"))
    present = present.join(sizes, ["lang", "block"], "left").withColumn("block_terms", F.coalesce("block_terms", F.lit(0).cast("long")))
    key = ["lang", "block", "tile", "other_tile"]
    # Columns of their own: both sides come from the same tables.
    rows, present = (t.select([F.col(c).alias(c) for c in t.columns]) for t in (rows, present))
    sums = rows.groupBy(*key).cogroup(present.groupBy(*key)).applyInArrow(partial(_tile_sums, source_tile), "lang string, a long, b long, value long")
    sums = durable(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    mine, theirs = groups.select("lang", F.col("number").alias("a"), "source"), groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    return both.join(mine, ["lang", "a"]).join(theirs, ["lang", "b"]).select("lang", "source", "item", "value")


def _top_terms(kept: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value)`` of the terms that may be among the first ``top`` of their group, from two rounds of skybands."""
    band = _partition_skybands(top)
    local = kept.where("p > q").select("lang", "source", "term", "n", "lang_n", "p", "q").mapInArrow(band, _BAND)
    local = local.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    merged = local.repartition("lang", "source", "part").drop("part").mapInArrow(band, _BAND)
    return merged.select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))


def divergence_audit(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    term_block: int = TERM_BLOCK,
    source_tile: int = SOURCE_TILE,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each source of a language its distance to each other source
    (part ``pair``) and the ``top`` terms that it has more often than the language (part ``term``).

    Of every kept term a group has the chance ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``, with N its occurrences of
    kept terms and V the kept terms of the language, and two groups differ by ``floor((p - q)^2 / (p + q))``: summed over all
    kept terms for a pair, by term against the whole language for part ``term``. Ranks are by value, then by UTF-8 of the item.

    Null text, lang or source count as empty, and an empty lang or source is one like any other. Each row is a document,
    so repeated rows count again. A source without terms, or a language that keeps none, still has its pairs. Texts are
    counted whole; a task holds some ``HELD_TERMS`` counts, whatever the texts' length. Other columns are ignored, and an
    empty table gives no rows.
    """
    short_batches(docs.sparkSession)

    def plain(column: str, name: str) -> Column:
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(name)

    read = docs.select(plain(lang_column, "lang"), plain(source_column, "source"), plain(text_column, "text"))
    # One shuffle by term: its sources are added up there and then, together, the rows of the language. A window is at most
    # one row a source.
    counted = read.mapInArrow(_count, _COUNTED).repartition("lang", "term").groupBy("lang", "term", "source")
    counted = counted.agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("documents").over(of_term).alias("documents"))
    counted = durable(counted.where((F.col("documents") >= least_documents) | F.col("term").isNull()).drop("documents"))
    terms = counted.where("term is not null")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang", "term").agg(F.min("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_total")
    # Sources of a language are numbered, and dealt into tiles: rows of the report, not of the documents.
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / source_tile)
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kept") / term_block))
    groups = durable(groups.select("*", number.alias("number"), tiles.alias("tiles"), blocks.alias("blocks")).withColumn("tile", F.floor(F.col("number") / source_tile)))
    p, q = _chance(F.col("n"), F.col("total"), F.col("kept")), _chance(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    # The hot sources have most rows, so groups go to the rows where they are few, and AQE parts the rows otherwise.
    small = F.broadcast(groups) if groups.count() <= GROUP_ROWS else groups
    kept = terms.join(small, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", p.alias("p"), q.alias("q"), "number", "tile", "tiles", "blocks")
    kept = durable(kept)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups, source_tile).withColumn("rank", F.row_number().over(order))
    terms = _top_terms(kept, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
