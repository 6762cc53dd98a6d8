"""SimHash near-duplicates: Golay codes as fuzzy keys for segments of a fingerprint.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most four bits, the errors of the segments are, in
order, (0, 0, any), (0, 1, any), (0, 2, 2), (1, 1, 1) or (1, 1, 2). So either
two segments differ in at most one bit each, or one is equal and the others differ in two.

* Two segments A, B with one error each: one row (index near A, index of B), another (index of A, index near B).
  The two rows of a pair meet, since each side's own index is near the other.
* A equal, B with two errors: (A itself, index near B), where both have the word between them.

Rows meet by key; fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import golay, shared_keys
from eventloom.llm.batches import short_batches, sorted_groups, text_rows, words_of
from eventloom.llm.components import connected_components
from eventloom.session import durable

HASH_SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
# Fingerprints of one key that one task compares; more are compared block by block.
GROUP_LIMIT = 8192


def fingerprint(text: str, words: int) -> int:
    """SimHash of all word shingles, repeats counted; a text with fewer words is one shingle, without words zero."""
    tokens = words_of(text)
    if not tokens:
        return 0
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(line, HASH_SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65_536):
        pairs = zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)
        counts += _bit_counts(np.array([digest(line[s:e], HASH_SEED) for s, e in pairs], np.uint64))
    return _majority(counts, len(starts))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, copy, fingerprint)`` of every row, as a signed long; ``copy`` is a hash of the whole text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(found.view(np.int64))], ["id", "copy", "fingerprint"])

    rows = text_rows(docs, id_column, text_column)
    return rows.withColumn("copy", F.xxhash64("text")).mapInArrow(run, "id long, copy long, fingerprint long")


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of uint64 fingerprints: within four bits of each other they share a key."""
    words = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    own = [golay.decode(w).astype(np.int64) for w in words]
    near = [golay.nearby(w, bits) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
    rows, keys = [], []

    def add(family: int, row: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        rows.append(row)
        keys.append(family << 40 | high.astype(np.int64) << 12 | low)

    for family, (a, b) in enumerate(((0, 1), (1, 2), (0, 2))):
        row, index = near[a]
        add(family, row, index, own[b][row])
        row, index = near[b]
        other = index != own[b][row]  # the pair of both own indices is there already
        add(family, row[other], own[a][row[other]], index[other])
    for family, (a, b) in enumerate(((0, 1), (1, 2), (2, 0)), start=3):
        row, index = near[b]
        add(family, row, words[a][row], index)
    return np.concatenate(rows), np.concatenate(keys)


def _linked_pairs(
    keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, max_bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a group of rows with one key connects, for all groups at once."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for d in range(1, min(16, int(sizes.max()))):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        linked = same[np.bitwise_count(prints[same + d] ^ prints[same]) <= max_bits]
        yield ids[linked], ids[linked + d]
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        yield _clusters(prints[start : start + size], ids[start : start + size], max_bits)


def _clusters(prints: np.ndarray, ids: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star of links for each connected set, found breadth first; a dense set costs about one comparison a row."""
    order = np.argsort(ids, kind="stable")
    prints, ids = prints[order], ids[order]
    rest = np.arange(len(ids))
    left, right = [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        edge = np.array([root])
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(edge), 256):
                todo = np.flatnonzero(~near)
                apart = np.bitwise_count(prints[edge[at : at + 256], None] ^ prints[None, rest[todo]])
                near[todo[(apart <= max_bits).any(axis=0)]] = True
            edge, rest = rest[near], rest[~near]
            left.append(np.full(len(edge), ids[root]))
            right.append(ids[edge])
    return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])


def _meet(rows: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """``(kind, key, a, b)``: links (kind 0), and the rows of keys over ``limit`` as they are (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            kinds = np.full(len(a), kind, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, key, a, b)], ["kind", "key", "a", "b"])

        for table, large in sorted_groups(batches, "key", limit):
            keys, prints, ids = (table.column(c).to_numpy() for c in ("key", "print", "id"))
            if large:
                yield out(1, keys, ids, prints)
                continue
            found = list(_linked_pairs(keys, prints.view(np.uint64), ids, max_bits))
            if found and sum(len(a) for a, _ in found):
                a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
                yield out(0, np.zeros(len(pairs), np.int64), pairs[:, 0].copy(), pairs[:, 1].copy())

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "kind int, key long, a long, b long")


def links(prints: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``(a, b)`` pairs of ids that connect all fingerprints within ``max_bits`` (four at most).

    ``prints`` has one row ``(id, print)`` for each distinct fingerprint. Keys with
    more than ``limit`` rows are dealt out as pairs of blocks of half that size,
    so every pair of rows still meets.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys are made for 0 to {MAX_BITS} bits")
    spark = prints.sparkSession
    short_batches(spark)
    block = max(1, limit // 2)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("id").to_numpy(), batch.column("print").to_numpy()
            row, key = fuzzy_keys(found.view(np.uint64))
            for at in range(0, len(row), 8192):
                r = row[at : at + 8192]
                columns = [pa.array(key[at : at + 8192]), pa.array(found[r]), pa.array(ids[r])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "print", "id"])

    rows = prints.select("id", "print").mapInArrow(keyed, "key long, print long, id long")
    met = durable(_meet(rows, max_bits, limit))
    pairs = met.where("kind = 0").select("a", "b")
    heavy = met.where("kind = 1").select("key", F.col("a").alias("id"), F.col("b").alias("print"))
    while not heavy.isEmpty():
        blocks = heavy.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block * 0.75)).alias("blocks"))
        placed = heavy.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("print", "key"), F.col("blocks")))
        both = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cells = both.select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "print", "id"
        )
        met = durable(_meet(cells, max_bits, limit * 2))
        pairs = pairs.unionByName(met.where("kind = 0").select("a", "b"))
        heavy = met.where("kind = 1").select("key", F.col("a").alias("id"), F.col("b").alias("print"))
        limit *= 2
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, copy, fingerprint, component)`` for every row; component is the smallest id reachable by links.

    ``copy`` is a hash of the row's whole text, for rows that share an id.

    Texts link when their fingerprints differ in at most ``max_bits`` bits. Copies
    are joined by fingerprint first, so a text with a third of all rows is one
    row afterwards. Null text counts as empty; texts without words have
    fingerprint zero and link as any other. A row without an id keeps its
    fingerprint, links nothing and has a null component. Repeated rows stay
    repeated, other columns are ignored, and an empty table gives no rows.
    """
    rows = durable(fingerprints(docs, words, id_column, text_column))
    known = rows.where("id is not null").groupBy(F.col("fingerprint").alias("print")).agg(F.min("id").alias("id"))
    known = durable(known)
    # Fingerprints are what is linked, so that rows with one id and several texts do not join what their texts do not.
    groups = connected_components(links(known.select(F.col("print").alias("id"), "print"), max_bits))
    rooted = durable(known.join(groups, known.print == groups.node, "left").select("print", "id", F.coalesce("component", "print").alias("root")))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = rooted.join(least, "root").select(F.col("print").alias("fingerprint"), "component")
    return rows.join(named, "fingerprint", "left").select(
        "id", "copy", "fingerprint", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


# Near copies by similarity: the first shingles of each text in one order are its keys, whole sets decide.
BROADCAST_ROWS = 200_000  # ids of texts; longer lists are joined by shuffle


def _shingles(text: str, words: int) -> np.ndarray:
    tokens = words_of(text)
    parts = {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64))


def _texts_of(ids: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    wanted = durable(ids.distinct())
    return text_rows(docs, id_column, text_column).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "id")


def _shingle_keys(texts: DataFrame, words: int, similarity: float, frequent: list[int]) -> DataFrame:
    """``(key, a, n, rank)``: of each text the first shingles in one order, frequent ones last.

    A similar text has at least that share of the n shingles, so one more than may be
    lacking must hold a common one.
    """
    sent = texts.sparkSession.sparkContext.broadcast(np.array(frequent, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.sort(sent.value.view(np.uint64))
        for batch in batches:
            parts = []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _shingles(text, words)
                n = len(found)
                order = np.sort(found >> np.uint64(2) | np.isin(found, last).astype(np.uint64) << np.uint64(62)).view(np.int64)
                order = order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                parts.append((order, np.full(len(order), ident, np.int64), np.full(len(order), n, np.int64), np.arange(len(order))))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            for at in range(0, len(columns[0]) if parts else 0, 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8192]) for c in columns], ["key", "a", "n", "rank"])

    return texts.mapInArrow(run, "key long, a long, n long, rank long")


def _frequent_shingles(texts: DataFrame, words: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(text, words).view(np.int64))], ["shingle"])

    return shared_keys.frequent(texts.where(shared_keys.sampled(F.col("id"))).mapInArrow(run, "shingle long"))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """Pairs whose sets of word shingles have at least that Jaccard similarity."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, id_column, text_column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = texts.mapInArrow(read, "id long, set binary").dropDuplicates(["id"])
    sides = [sets.select(F.col("id").alias(i), F.col("set").alias(s)) for i, s in (("a", "x"), ("b", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, component)`` for every row: the smallest id reachable through texts that are similar.

    Texts are similar if the Jaccard similarity of their sets of word shingles is
    at least ``similarity``. All such pairs are found: they have one of their first
    shingles in common (see ``shared_keys``), and no candidate that would join two
    groups is left out. Equal word sequences are joined before. Nulls, empty texts,
    repeated rows, other columns and empty tables are as in ``near_duplicates``; of
    rows with one id, one text is compared.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [xxhash.xxh64_intdigest(b" ".join(words_of(t))) for t in batch.column("text").to_pylist()]
            columns = [batch.column("id"), pa.array(np.array(contents, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "content"])

    rows = durable(text_rows(docs, id_column, text_column).mapInArrow(run, "id long, content long"))
    known = durable(rows.where("id is not null").groupBy("content").agg(F.min("id").alias("id")))
    texts = _texts_of(known.select("id"), docs, id_column, text_column)

    def may(n: Column, rank: Column, other_n: Column, other_rank: Column) -> Column:
        both = (n + other_n) * (similarity / (1 + similarity)) - 1e-6
        return (rank <= n - both) & (other_rank <= other_n - both)

    keyed = _shingle_keys(texts, words, similarity, _frequent_shingles(texts, words))
    links = shared_keys.links_by_keys(keyed, may, lambda pairs: _verified(pairs, docs, words, similarity, id_column, text_column))
    groups = connected_components(links)
    named = known.join(groups, known.id == groups.node, "left").select("content", F.coalesce("component", "id").alias("component"))
    return rows.join(named, "content", "left").select(
        "id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )
