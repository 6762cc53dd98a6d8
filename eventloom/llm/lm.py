"""Scores of texts under an n-gram model, by a weighted backoff automaton.

Counts cover all training texts and belong to no one machine. Texts are dealt into shards of bounded size.
Each shard sends its distinct n-grams, with their counts in its training texts, to buckets by hash; a bucket
adds them up over all shards and answers each shard with the totals of the n-grams it sent, in their order. From
those a shard builds the part of the automaton that its own texts can reach, and traverses them.

Smoothing is by Dirichlet priors: ``p(w | h) = (c(hw) + M p(w | h')) / (c(h) + M)``, where h' is h without its
first word, and ``p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))``. A seen n-gram is an arc with that weight. Where
a state has no arc for a word, its failure arc leads to the shorter context with weight ``M / (c(h) + M)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.batches import held_out, short_batches, text_rows, words_of

ORDER = 2
PRIOR = 500.0  # M, in words
ADDED = 0.1
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20  # of text, for each bucket of n-gram counts
# Hashes of the marks around a text; words hash otherwise but for a chance of one in 2**64.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))


def _join(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from that of its first words and its last."""
    with np.errstate(over="ignore"):
        x = before * _MIX[0] + word
        x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes by place, compressed: high bytes of small numbers and of steps between sorted keys are alike."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each occurs, and the number of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], number


@dataclass
class Shard:
    """The tokens of some texts: each text is start marks, its words and an end mark."""

    tokens: np.ndarray
    real: np.ndarray  # words and end marks
    counted: np.ndarray  # those, and the last start mark of each text
    lengths: np.ndarray  # with start marks

    @classmethod
    def read(cls, texts: list[str], order: int) -> Shard:
        known = _Hashes()
        flat: list[int] = []
        lengths = []
        marks = [int(START)] * (order - 1)
        for text in texts:
            words = words_of(text)
            flat += marks
            flat += map(known.__getitem__, words)
            flat.append(int(END))
            lengths.append(len(words) + order)
        lengths = np.array(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        real, counted = np.ones(len(flat), bool), np.ones(len(flat), bool)
        for i in range(order - 1):
            real[starts + i] = False
            counted[starts + i] = i == order - 2
        return cls(np.array(flat, np.uint64), real, counted, lengths)

    def keys(self, order: int) -> list[np.ndarray]:
        """Keys of the n-grams that end at each token, n from 1; before a text's start they mean nothing."""
        out = [self.tokens]
        for _ in range(order - 1):
            out.append(_join(np.r_[START, out[-1][:-1]], self.tokens))
        return out


def _requests(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """A shard's distinct n-grams with their training counts, cut by bucket; every bucket of single words is asked."""
    shard = Shard.read(table.column("text").to_pylist(), order)
    train = np.repeat(~table.column("held_out").to_numpy(), shard.lengths) & shard.counted
    rows = []
    number = table.column("shard")[0].as_py()
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    for n, keys in enumerate(shard.keys(order), start=1):
        wanted = np.unique(keys[shard.counted])
        seen, times = np.unique(keys[train], return_counts=True)
        counts = np.zeros(len(wanted), np.uint32)
        counts[np.searchsorted(wanted, seen)] = times
        cuts = np.r_[0, np.searchsorted(wanted, edges), len(wanted)]
        for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a < b or n == 1:
                steps = np.diff(wanted[a:b], prepend=np.uint64(0))
                rows.append((n, bucket, number, _squeeze(steps), _squeeze(counts[a:b])))
    return _table(rows, REQUEST)


REQUEST = {"n": pa.int32(), "bucket": pa.int64(), "shard": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
ANSWER = {"shard": pa.int64(), "n": pa.int32(), "bucket": pa.int64(), "totals": pa.binary(), "all_tokens": pa.int64(), "all_words": pa.int64()}
SCORE = {"id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})


def _schema(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items())


def _answers(table: pa.Table) -> pa.Table:
    """Totals over all shards of the n-grams of one bucket, for each shard in the order it sent them."""
    keys = [np.cumsum(_expand(x, "u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = [_expand(x, "u4") for x in table.column("counts").to_pylist()]
    every, _, back = _distinct(np.concatenate(keys))
    totals = np.bincount(back, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    words = totals[every != START]
    facts = (int(words.sum()), int((words > 0).sum())) if table.column("n")[0].as_py() == 1 else (0, 0)
    rows, at = [], 0
    names = zip(*(table.column(c).to_pylist() for c in ("shard", "n", "bucket")), strict=True)
    for name, own in zip(names, keys, strict=True):
        rows.append((*name, _squeeze(totals[back[at : at + len(own)]].astype(np.uint64)), *facts))
        at += len(own)
    return _table(rows, ANSWER)


class Automaton:
    """States are contexts that training texts have; 0 is the empty one.

    A state whose context has n words has, at some place of a text, an arc if the
    n + 1 words that end there are a seen n-gram; arcs are therefore kept by
    that length and place. An arc leads to the longest suffix of its words that
    is a state. A word that no state knows costs ``unknown`` and leads to state 0.
    """

    def __init__(self, shard: Shard, totals: list[np.ndarray], order: int, all_tokens: int, all_words: int):
        keys = shard.keys(order)
        spots = np.flatnonzero(shard.counted)
        distinct, firsts, at = [], [], []
        for k in keys:
            found, first, number = _distinct(k[spots])
            place = np.zeros(len(k), np.int64)  # of uncounted tokens never used
            place[spots] = number
            distinct.append(found)
            firsts.append(spots[first])
            at.append(place)
        self.symbol = at[0]
        scale = all_tokens + ADDED * (all_words + 1)
        self.unknown = float(np.log10(ADDED / scale))
        is_end = shard.tokens == END
        # The state of each n-gram shorter than the order, 0 where training texts never go on from it.
        state, fail_to, fail_cost, depth, size = [], [0], [0.0], [0], 1
        for n in range(1, order):
            live = (totals[n - 1] > 0) & ~is_end[firsts[n - 1]]
            numbers = np.where(live, np.cumsum(live) + size - 1, 0)
            state.append(numbers)
            size += int(live.sum())
            lower = state[n - 2][at[n - 2][firsts[n - 1][live]]] if n > 1 else np.zeros(int(live.sum()), np.int64)
            fail_to += lower.tolist()
            fail_cost += np.log10(PRIOR / (totals[n - 1][live] + PRIOR)).tolist()
            depth += [n] * len(lower)
        self.fail_to, self.fail_cost, self.depth = fail_to, fail_cost, depth
        self.start = 0
        for n in range(order - 1, 0, -1):
            marks = np.array([START])
            for _ in range(n - 1):
                marks = _join(marks, np.array([START]))
            place = int(np.searchsorted(distinct[n - 1], marks[0]))
            if place < len(distinct[n - 1]) and distinct[n - 1][place] == marks[0] and state[n - 1][place]:
                self.start = int(state[n - 1][place])
                break
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by n: seen, weight and next state, at each place
        lower = (totals[0] + ADDED) / scale
        for n in range(1, order + 1):
            first, count = firsts[n - 1], totals[n - 1].astype(np.float64)
            if n == 1:
                chance = lower
            else:
                before = at[n - 2][first - 1]
                chance = (count + PRIOR * lower[at[n - 2][first]]) / (totals[n - 2][before] + PRIOR)
            target = np.zeros(len(first), np.int64)
            for m in range(1, min(n, order - 1) + 1):  # longer suffixes last
                longer = state[m - 1][at[m - 1][first]]
                target = np.where(longer > 0, longer, target)
            here = at[n - 1]
            self.arcs.append(((count > 0)[here], np.log10(chance)[here], target[here]))
            lower = chance

    def traverse(self, start: int, end: int) -> float:
        """The log10 probability of the text whose words and end mark stand at these places."""
        seen, weight, after = zip(*[[column[start:end].tolist() for column in arcs] for arcs in self.arcs], strict=True)
        fail_to, fail_cost, depth = self.fail_to, self.fail_cost, self.depth
        state, total = self.start, 0.0
        n = depth[state]
        for place in range(end - start):
            while not seen[n][place] and n:
                total += fail_cost[state]
                state = fail_to[state]
                n = depth[state]
            if seen[n][place]:
                total += weight[n][place]
                state = after[n][place]
                n = depth[state]
            else:
                total += self.unknown
        return total


def _scores(docs: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    """Scores of the texts of one shard."""
    if not docs.num_rows:
        return _table([], SCORE)
    shard = Shard.read(docs.column("text").to_pylist(), order)
    answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
    sizes = answers.column("n").to_numpy()
    blobs = answers.column("totals").to_pylist()
    totals = [np.concatenate([_expand(b, "u8").astype(np.int64) for b, m in zip(blobs, sizes, strict=True) if m == n]) for n in range(1, order + 1)]
    all_tokens, all_words = (int(np.sum(answers.column(c).to_numpy()[sizes == 1])) for c in ("all_tokens", "all_words"))
    automaton = Automaton(shard, totals, order, all_tokens, all_words)
    seen = totals[0][np.minimum(automaton.symbol, len(totals[0]) - 1)]
    base = np.log10((seen + ADDED) / (all_tokens + ADDED * (all_words + 1)))
    rows, at = [], 0
    for ident, held, length in zip(docs.column("id").to_pylist(), docs.column("held_out").to_pylist(), shard.lengths.tolist(), strict=True):
        a, b = at + order - 1, at + length
        rows.append((ident, held, b - a, int((seen[a:b] > 0).sum()), all_tokens, float(base[a:b].sum()), automaton.traverse(a, b)))
        at = b
    return _table(rows, SCORE)


def score(docs: DataFrame, parts: int = 10, part: int = 0, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Rows whose crc32 of the id leaves ``part`` on division by ``parts`` are held
    out of training, a row without an id is not. ``base_score`` is the
    log10 probability under single words alone, ``score`` under the automaton;
    with nothing to train on, both use the chances of unknown words. Null and
    empty texts are the end mark alone. Repeated rows train and are scored again, other
    columns are ignored, and an empty table gives no rows. A shard holds
    about SHARD_BYTES of text, or one text where that is longer.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = text_rows(docs, id_column, text_column)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, buckets = max(1, -(-size // SHARD_BYTES)), max(1, -(-size // BUCKET_BYTES))
    rows = rows.select(
        "id", "text", held_out(F.col("id"), parts, part).alias("held_out"), F.pmod(F.xxhash64("id", "text"), F.lit(shards)).alias("shard")
    )
    asked = rows.groupBy("shard").applyInArrow(lambda t: _requests(t, order, buckets), _schema(REQUEST))
    answers = asked.groupBy("n", "bucket").applyInArrow(_answers, _schema(ANSWER))
    return (
        rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda a, b: _scores(a, b, order), _schema(SCORE))
    )
