"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and their first letters, hashed to 32 bits, each
counted once. The score of a set of terms is a bias, a weight for each term, and
for each pair of terms the product of their factor vectors, so that two terms
can mean together what neither means alone. Weights are learnt by FTRL with an
L1 penalty, which leaves most at zero. In the first epochs only terms with a weight
have factors, so that what terms say alone is learnt first; then all terms have
factors, and what is left wrong teaches pairs of terms that say nothing alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eventloom.llm.batches import short_batches, text_rows

SAMPLE_ROWS = 20_000  # labelled rows, with the smallest hashes of their ids, that a model is fitted on
PREFIXES = (4, 5, 6)  # letters of shorter terms that stand for all words beginning with them
FACTORS = 4
EPOCHS = 4  # with factors for terms that have a weight
PAIR_EPOCHS = 4  # with factors for all terms, after those
LEAST_DOCUMENTS = 4  # of the sample that have a term; rarer ones would only be learnt by heart
RATE, SMOOTH, L1, L2 = 1.0, 1.0, 3.0, 0.1  # of FTRL
FACTOR_RATE, FACTOR_START = 0.02, 0.005  # the latter is the spread of factors before they are learnt
LEAST_FACTOR = 0.02  # a term without a weight whose factors are shorter has learnt nothing and is left out
THRESHOLD = 0.3
CACHE_WORDS = 500_000
_WORD = re.compile(r"\w+")


def terms(chunk: str) -> list[int]:
    """Hashes of the words in a chunk without white space, and of their prefixes."""
    out = []
    for word in _WORD.findall(chunk):
        out.append(zlib.crc32(word.encode()))
        out += [zlib.crc32(f"{n}:{word[:n]}".encode()) for n in PREFIXES if len(word) >= n]
    return out


def text_terms(text: str) -> np.ndarray:
    """The distinct terms of a whole text, sorted."""
    found = {t for chunk in set(text.lower().split()) for t in terms(chunk)}
    return np.array(sorted(found), np.uint32)


class Model:
    """``bias + sum of weights + sum over pairs of factor products``, as a probability."""

    def __init__(self, bias: float, hashes: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.hashes, self.weights, self.factors = bias, hashes, weights, factors
        self.index = {h: i for i, h in enumerate(hashes.tolist())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _known(self, chunk: str) -> tuple[int, ...]:
        found = self.cache.get(chunk)
        if found is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            found = self.cache[chunk] = tuple(self.index[t] for t in terms(chunk) if t in self.index)
        return found

    def score(self, text: str) -> float:
        hit = sorted({i for chunk in set(text.lower().split()) for i in self._known(chunk)})
        return _probability(self.bias + self.weights[hit].sum() + _pairs(self.factors[hit]))


def _probability(total: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _pairs(factors: np.ndarray) -> float:
    return float(((factors.sum(0) ** 2) - (factors**2).sum(0)).sum() / 2)


def fit(rows: list[tuple[int, int, np.ndarray]]) -> Model:
    """A model for ``(order, label, terms)`` rows, by their order; without rows all scores are a half.

    A term's weight counts by the logarithm of its rarity, so that frequent words
    say little; its factors by the fourth root of that, since words that are
    frequent alone can be rare together.
    """
    rows = sorted(rows, key=lambda r: r[:2])
    hashes, seen = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True) if rows else (np.zeros(0, np.uint32),) * 2
    hashes, seen = hashes[seen >= LEAST_DOCUMENTS], seen[seen >= LEAST_DOCUMENTS]
    places = []
    for _, _, found in rows:
        at = np.searchsorted(hashes, found)
        places.append(at[np.append(hashes, 0)[at] == found] if len(hashes) else at[:0])
    size = len(hashes) + 1  # the last is the bias, which has no penalty
    value = np.append(np.log(max(2, len(rows)) / np.maximum(seen, 1)) / np.log(max(2, len(rows))), 1.0)
    scale = value[:-1, None] ** 0.25
    penalty = np.append(np.full(size - 1, L1), 0.0)
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    random = np.random.default_rng(0)
    v, vn = random.normal(0, FACTOR_START, (size - 1, FACTORS)), np.ones((size - 1, FACTORS))
    for epoch in range(EPOCHS + PAIR_EPOCHS):
        for i in random.permutation(len(rows)):
            at = np.append(places[i], size - 1)
            x = value[at]
            paired = places[i] if epoch >= EPOCHS else places[i][w[places[i]] != 0]
            f = v[paired] * scale[paired]
            slope = _probability(w[at] @ x + _pairs(f)) - rows[i][1]
            if abs(slope) < 1e-4:
                continue
            old = n[at]
            n[at] = old + (slope * x) ** 2
            z[at] += slope * x - (np.sqrt(n[at]) - np.sqrt(old)) / RATE * w[at]
            zs = z[at]
            w[at] = np.where(
                np.abs(zs) <= penalty[at], 0, -(zs - np.sign(zs) * penalty[at]) / ((SMOOTH + np.sqrt(n[at])) / RATE + L2)
            )
            if len(paired) > 1:
                grad = slope * (f.sum(0) - f) * scale[paired]
                vn[paired] += grad**2
                v[paired] -= FACTOR_RATE * grad / np.sqrt(vn[paired])
    factors = v * scale
    used = np.flatnonzero((w[:-1] != 0) | ((factors**2).sum(1) > LEAST_FACTOR**2))
    return Model(float(w[-1]), hashes[used], w[used] * value[used], factors[used])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids.

    The sample is bounded, so its ids may be sent to all tasks and its terms to
    one, which fits the model. Of several labels of a document the highest
    counts; labels that are null or belong to no document are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    marked = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
    marked = marked.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = marked.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(sample_rows)
    texts = text_rows(docs, id_column, text_column).join(F.broadcast(chosen), "id").select("order", "label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_terms(t).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column("order"), batch.column("label"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["order", "label", "terms"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            order, label, found = (batch.column(c).to_pylist() for c in ("order", "label", "terms"))
            rows += [(o, y, np.frombuffer(t, np.uint32)) for o, y, t in zip(order, label, found, strict=True)]
        rows = list({(o, y, t.tobytes()): (o, y, t) for o, y, t in rows}.values())  # a repeated document counts once
        model = fit(rows)
        parts = [np.array([model.bias]), model.hashes, model.weights, model.factors]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["bias", "hashes", "weights", "factors"])

    found = texts.mapInArrow(read, "order long, label int, terms binary").repartition(1)
    row = found.mapInArrow(train, "bias binary, hashes binary, weights binary, factors binary").first()
    if row is None:  # Spark plans no task for a table known to be empty
        return fit([])
    return Model(
        float(np.frombuffer(row["bias"])[0]),
        np.frombuffer(row["hashes"], np.uint32),
        np.frombuffer(row["weights"]),
        np.frombuffer(row["factors"]).reshape(-1, FACTORS),
    )


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, score)`` for every row, from the whole text alone: 0 to 1, higher for toxic.

    Null text counts as empty and gets the score of no terms. Rows without an id
    are scored, repeated rows stay repeated, other columns are ignored, and an
    empty table gives no rows. The model is bounded by the sample it was fitted on.
    """
    return add_score(text_rows(docs, id_column, text_column), model, "score").select("id", "score")


def add_score(docs: DataFrame, model: Model, name: str, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of each row under ``name``."""
    spark = docs.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast((model.bias, model.hashes, model.weights, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            yield batch.append_column(name, pa.array([own.score(t or "") for t in texts], pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))
