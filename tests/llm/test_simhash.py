from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from eventloom.llm import golay, simhash
from eventloom.llm.components import connected_components
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SF, empty


def plain_print(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    parts = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_golay_decodes_all_errors_of_three_bits():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = golay.decode(words)
    whole = golay.decode(words ^ 0)
    assert (index == whole).all() and index.max() < 4096
    for places in random.Random(2).sample(list(combinations(range(23), 3)), 30):
        codeword = words ^ golay._tables()[1][np.array([golay._remainder(int(w)) for w in words])]
        assert (golay.decode(codeword ^ sum(1 << p for p in places)) == codeword >> 11).all()


def test_words_two_bits_apart_share_an_index_and_have_six_at_most():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 21, 3000)
    other = words ^ (1 << rng.integers(0, 21, 3000)) ^ (1 << rng.integers(0, 21, 3000))
    keys = [[set() for _ in words] for _ in range(2)]
    for side, values in enumerate((words, other)):
        for row, index in zip(*golay.nearby(values, 21), strict=True):
            keys[side][row].add(index)
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert max(map(len, keys[0])) <= 6


def test_any_four_bits_share_a_key():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    other = prints.copy()
    for i in range(4000):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    found = [[set() for _ in prints] for _ in range(2)]
    for side, values in enumerate((prints, other)):
        for row, key in zip(*simhash.fuzzy_keys(values), strict=True):
            found[side][row].add(key)
    assert all(a & b for a, b in zip(*found, strict=True))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: plain_print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    linked = [(a, b) for a, b in combinations(docs, 2) if (docs[a] ^ docs[b]).bit_count() <= 4]
    expected = components(docs, linked)
    found = QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{p:016x}", expected[d]) for d, p in docs.items()}


def test_odd_rows(spark, tiny):
    found = simhash.near_duplicates(tiny).collect()
    assert len(found) == 11
    by_id = {r.id: r for r in found}
    assert by_id[2].component == by_id[1].component == 1
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == 0
    assert by_id[4].component == by_id[5].component == 3
    assert by_id[None].component is None
    assert by_id[8].component == by_id[9].component == 8
    assert simhash.near_duplicates(empty(tiny)).count() == 0


@pytest.mark.parametrize("limit", [4, 40])
def test_keys_over_the_limit_are_compared_in_blocks(spark, limit):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 60)})
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "id long, print long")
    linked = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = components(range(len(prints)), linked)
    found = {r.node: r.component for r in connected_components(simhash.links(table, limit=limit)).collect()}
    assert {n: found.get(n, n) for n in expected} == expected


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (200, 201), (201, 200), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(edges.where("false")).count() == 0


def test_near_copies_by_similarity(spark):
    rng = random.Random(6)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[base * 10] = " ".join(words)
        for copy in (1, 2):  # three words changed of 300: similarity over 0.8
            changed = list(words)
            for _ in range(3):
                changed[rng.randrange(300)] = f"x{rng.randrange(5000)}"
            texts[base * 10 + copy] = " ".join(changed)
        texts[base * 10 + 3] = " ".join(words[:150] + [f"y{rng.randrange(5000)}" for _ in range(150)])  # half alike
    found = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {i: i - i % 10 if i % 10 < 3 else i for i in texts}


def test_near_copies_of_odd_rows(spark, tiny):
    found = {r.id: r.component for r in simhash.near_copies(tiny).collect()}
    assert found[2] == 1 and found[4] == found[5] == 3 and found[6] == 6 and found[None] is None and found[9] == 8
    assert simhash.near_copies(empty(tiny)).count() == 0


def near_groups(texts):
    """Components of texts by brute force on five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    pairs = combinations(texts, 2)
    return components(texts, [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])


def test_near_copies_with_appended_cut_and_scattered_edits(spark):
    rng = random.Random(7)

    def new(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    texts, planted = {}, {}
    for base in range(0, 600, 10):
        words = new(rng.choice((12, 100, 300)))
        n = len(words)
        scattered = list(words)
        for at in rng.sample(range(n), n // 60):
            scattered[at] = new(1)[0]
        edits = [words + new(n * 10 // 100), words + new(n * 15 // 100), words + new(n * 20 // 100), words[: n - n * 15 // 100], scattered]
        for i, text in enumerate([words, *edits, words + new(n * 40 // 100)]):
            texts[base + i] = " ".join(text)
        planted |= {base + i: base for i in range(6)} | {base + 6: base + 6}
    expected = near_groups(texts)
    assert sum(expected[i] == planted[i] for i in texts) > 0.9 * len(texts)
    found = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == expected


def test_near_copies_among_many_texts_of_the_same_words(spark):
    rng = random.Random(8)
    records = [" ".join(f"r{r}f{f}" for f in range(8)) for r in range(40)]
    texts = {}
    for i in range(120):
        order = rng.sample(records, len(records))
        texts[i] = " ".join(order)
        words = texts[i].split()
        words[rng.randrange(len(words))] = f"changed{i}"
        texts[1000 + rng.randrange(10**6) * 1000 + i] = " ".join(words)
    expected = near_groups(texts)
    assert len(set(expected.values())) == 120
    found = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == expected
