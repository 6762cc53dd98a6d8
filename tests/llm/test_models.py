from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import lm, toxicity
from eventloom.llm.batches import held_out
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SF, empty


def plain_scores(texts, out, order=2):
    """Scores by dictionaries of counts, straight from the definition."""
    tokens = [[0] * (order - 1) + (t or "").encode().lower().split() + [None] for t in texts]
    counts = [Counter() for _ in range(order + 1)]
    contexts = Counter()
    for row, held in zip(tokens, out, strict=True):
        if not held:
            for i in range(order - 1, len(row)):
                for n in range(1, order + 1):
                    counts[n][tuple(row[i - n + 1 : i + 1])] += 1
                    contexts[tuple(row[i - n + 1 : i])] += n > 1
    total, words = sum(counts[1].values()), len(counts[1])

    def chance(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 0.1) / (total + 0.1 * (words + 1))
        return (counts[len(gram)][gram] + lm.PRIOR * chance(gram[1:])) / (contexts[gram[:-1]] + lm.PRIOR)

    rows = []
    for row in tokens:
        real = row[order - 1 :]
        base = sum(log10(chance((w,))) for w in real)
        full = sum(log10(chance(tuple(row[i - order + 1 : i + 1]))) for i in range(order - 1, len(row)))
        rows.append((len(real), sum(counts[1][w,] > 0 for w in real), total, base, full))
    return rows


def test_scores_equal_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in docs]
    expected = plain_scores([r.text for r in docs], out)
    found = {r.doc_id: r for r in QUERIES["op9_lm_scoring"](spark, SF).collect()}
    for row, held, plain in zip(docs, out, expected, strict=True):
        got = found[row.doc_id]
        assert got.held_out == held and (got.n_tokens, got.n_known, got.train_tokens) == plain[:3]
        assert (got.base_score, got.score) == pytest.approx(plain[3:], abs=1e-8)


@pytest.mark.parametrize("order", [2, 3])
def test_orders_and_shards(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD_BYTES", 300)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 500)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, rng.integers(0, 40)) if x < 50) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)]
    expected = plain_scores(texts, out, order)
    for row in lm.score(table, order=order).collect():
        assert (row.n_tokens, row.n_known, row.train_tokens) == expected[row.id][:3]
        assert (row.base_score, row.score) == pytest.approx(expected[row.id][3:], abs=1e-8)


def test_chances_of_what_follows_add_up_to_one():
    texts = ["a b a c", "b a", "c c a b b", ""]
    shard = lm.Shard.read([*texts, "a", "a a", "a b", "a c", "a unseen"], 2)
    train = np.repeat([True] * 4 + [False] * 5, shard.lengths) & shard.counted
    totals = []
    for keys in shard.keys(2):
        distinct = np.unique(keys[shard.counted])
        totals.append(np.array([(keys[train] == k).sum() for k in distinct]))
    real = totals[0][np.unique(shard.tokens) != lm.START]
    automaton = lm.Automaton(shard, totals, 2, int(real.sum()), int((real > 0).sum()))
    ends = np.cumsum(shard.lengths)
    begins = ends - shard.lengths + 1
    after_a = [automaton.traverse(begins[i], ends[i] - (i > 4)) - automaton.traverse(begins[4], ends[4] - 1) for i in range(4, 9)]
    assert sum(10**x for x in after_a) == pytest.approx(1.0)


def test_scoring_odd_rows(spark, tiny):
    found = lm.score(tiny).collect()
    assert len(found) == 11 and {r.n_tokens for r in found if r.id in (3, 4, 5)} == {1}
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    assert lm.score(empty(tiny)).count() == 0
    alone = lm.score(tiny.where("doc_id = 3"), parts=1, part=0).first()  # nothing to train on
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0 and alone.base_score == alone.score == 0.0


def labelled(spark, n, seed):
    """A word is toxic only beside another: neither alone says anything."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"common{x}" for x in rng.integers(0, 40, 30)] + [f"rare{x}" for x in rng.integers(0, 9000, 10)]
        kind = i % 4
        words += ["insultword"] * (kind in (1, 3)) + ["groupword"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind == 3)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_pairs_of_terms_are_learnt(spark):
    rows = labelled(spark, 3000, 1)
    model = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    new = labelled(spark, 400, 2)
    scored = toxicity.score(new, model).join(new.withColumnRenamed("doc_id", "id"), "id").collect()
    right = np.mean([(r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored])
    assert right > 0.97


def combined(n, seed):
    """Two pairs of words, each word as often toxic as not: the label depends on the combination alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.integers(0, 2, 2)
        words = [f"alpha{a}", f"beta{b}", *(f"common{x}" for x in rng.integers(0, 40, 30)), *(f"rare{x}" for x in rng.integers(0, 9000, 10))]
        rows.append((i, int(a == b), toxicity.text_terms(" ".join(words))))
    return rows


def test_pairs_whose_words_say_nothing_alone_are_learnt():
    model = toxicity.fit(combined(4000, 1))
    new = {i: (label, found) for i, label, found in combined(400, 2)}
    right = []
    for label, found in new.values():
        total, place = model.bias, {h: k for k, h in enumerate(model.hashes.tolist())}
        known = [place[h] for h in found.tolist() if h in place]
        total += sum(model.weights[k] for k in known)
        right.append((1 / (1 + np.exp(-(total + pair_sum(model, known)))) >= toxicity.THRESHOLD) == bool(label))
    assert np.mean(right) > 0.95


def pair_sum(model, known):
    return sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(known) for b in known[:k])


def test_toxicity_query_equals_a_sum_over_pairs(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    place = {h: k for k, h in enumerate(model.hashes.tolist())}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = QUERIES["op10_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for row in found:
        words = {w for chunk in texts[row.doc_id].lower().split() for w in re.findall(r"\w+", chunk)}
        own = {zlib.crc32(t.encode()) for w in words for t in (w, *(f"{n}:{w[:n]}" for n in toxicity.PREFIXES if len(w) >= n))}
        known = sorted(place[h] for h in own if h in place)
        total = model.bias + sum(model.weights[k] for k in known) + pair_sum(model, known)
        assert row.score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-9)
        assert row.predicted == int(row.score >= toxicity.THRESHOLD)


def test_held_out_accuracy(spark):
    folder = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op10_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in found if r.toxic]
    named = [r.toxic for r in found if r.predicted]
    assert np.mean(caught) > 0.85 and np.mean(named) > 0.95


def test_learning_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(~held_out(F.col("doc_id"), 4, 2))
    turned = train.unionByName(labels.join(train, "doc_id", "left_anti").withColumn("toxic", 1 - F.col("toxic")))
    one, two = (toxicity.learn(docs, x.where(~held_out(F.col("doc_id"), 4, 2))) for x in (labels, turned))
    assert one.bias == two.bias and (one.hashes == two.hashes).all() and (one.weights == two.weights).all()


def test_toxicity_of_odd_rows(spark, tiny):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (6, 0, 1), (6, 1, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    model = toxicity.learn(tiny, labels)
    found = toxicity.score(tiny, model).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.add_score(tiny, model, "toxic").columns == [*tiny.columns, "toxic"]
    assert toxicity.score(empty(tiny), model).count() == 0
    assert toxicity.score(tiny, toxicity.learn(tiny, empty(labels))).agg(F.min("score")).first()[0] == 0.5


def test_a_bounded_sample_is_fitted(spark):
    rows = labelled(spark, 200, 3)
    small = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), sample_rows=8)
    assert len(small.hashes) <= 8 * 200
