from __future__ import annotations

import numpy as np
import pytest

from eventloom.llm import multi_index, topk
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SF, empty

SCHEMA = "vec_id long, embedding array<float>, label int, score int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2) for i, v, l in rows], SCHEMA)


def plain_top(rows, queries, k):
    found = []
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def test_top_k_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op5_exact_top_k"](spark, SF).collect()
    assert sorted(map(tuple, found)) == plain_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_top_k_in_many_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 10)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(400)]  # many ties
    data = table(spark, [(i, v, 0) for i, v in rows])
    found = topk.exact_top_k(data.where("vec_id % 20 = 0"), data, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found) == plain_top(rows, range(0, 400, 20), 3)


def test_top_k_of_odd_vectors(spark):
    big = 3e38
    rows = [
        (0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, None, 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0),
        (5, [float("inf"), 1.0], 0), (6, [big, big], 0), (7, [-1.0, 0.25], 0), (8, [1.0], 0), (None, [1.0, 1.0], 0), (9, [], 0),
    ]
    data = table(spark, rows)
    found = {}
    for r in topk.exact_top_k(data.where("vec_id in (0, 2, 6, 8, 9)"), data).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(found) == {0, 6}
    assert [x[1] for x in sorted(found[0])] == [6, 1, 7] and sorted(found[0])[0][2] == 2**63 - 1
    assert sorted(found[0])[1:] == [(2, 1, 256 * 256 + 128 * 128), (3, 7, -256 * 256 + 128 * 64)]
    assert topk.exact_top_k(data, empty(data)).count() == 0 and topk.exact_top_k(empty(data), data).count() == 0


def plain_links(rows, cosine):
    links, root = {}, {i: i for i, *_ in rows}
    vectors = [(i, np.array(v, np.float64), l) for i, v, l in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, l) in enumerate(vectors):
        for j, w, m in vectors[:a]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links.get(i, 0), find(i), find(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("side", [2048, 5])
def test_near_vectors_equal_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(multi_index, "SIDE_ROWS", side)
    rng = np.random.default_rng(2)
    rows = []
    for group in range(40):
        base = rng.normal(size=16)
        for copy in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.12 * (copy > 1)], group % 3))
    found = multi_index.near_duplicates(table(spark, rows)).collect()
    expected = plain_links(rows, 0.93)
    got = {r.id: (r.n_links, r.component, r.kept) for r in found}
    met, all_links = sum(x[0] for x in got.values()), sum(x[0] for x in expected.values())
    assert all_links > 500 and met >= 0.98 * all_links and all(got[i][0] <= expected[i][0] for i in got)
    assert np.mean([got[i][1] == expected[i][1] for i in got]) >= 0.98


def test_near_vector_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op8_embedding_near_dedup"](spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == plain_links(rows, 0.93)


def test_traversal_visits_cells_in_order_and_reaches_the_target():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(1500, 12))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    grid = multi_index.fit_grid(sample, 8, 0.93, 0.99)
    order = grid.cells(sample[:50], 64)
    first, second = sample[:50, :6], sample[:50, 6:]
    sums = ((first[:, None] - grid.first[None]) ** 2).sum(2)[:, :, None] + ((second[:, None] - grid.second[None]) ** 2).sum(2)[:, None, :]
    ordered = np.take_along_axis(sums.reshape(50, -1), order, 1)
    assert (np.diff(ordered, axis=1) >= -1e-9).all() and (np.sort(order, 1) == np.arange(64)).all()
    for visits in (1, 5, 20):
        assert (grid.cells(sample[:50], visits) == order[:, :visits]).all()
    assert 1 <= grid.visits < 64


def test_odd_vectors_link_with_nothing(spark):
    one, near = [1.0, 0.0, 1.0], [1.0, 0.0, 1.1]
    rows = [
        (1, one, 0), (2, near, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 1.0], 0),
        (8, [float("nan"), 0.0, 1.0], 0), (9, [1.0, 0.0], 0), (10, [], 0), (None, one, 0), (1, one, 0), (11, [1e-30, 0.0, 1e-30], 0),
    ]
    found = sorted(((r.id or 0, r.n_links, r.component, r.kept) for r in multi_index.near_duplicates(table(spark, rows)).collect()), key=str)
    assert found.count((1, 3, 1, True)) == 2 and (2, 3, 1, False) in found and (11, 3, 1, False) in found
    assert {x for x in found if x[0] not in (0, 1, 2, 11)} == {(i, 0, i, True) for i in range(3, 11)}
    assert (0, 0, None, False) in found and len(found) == 13
    assert multi_index.near_duplicates(empty(table(spark, rows))).count() == 0
