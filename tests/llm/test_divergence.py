from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from eventloom.llm import divergence
from tests.llm.conftest import SF, empty

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_audit(rows, least, top):
    """The report by its definition, over (text, lang, source)."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def chances(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = chances(counts[lang, source])
        everything = chances(sum((counts[lang, s] for s in sources), Counter()))

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        values = {"pair": [], "term": []}
        for other in sources:
            if other != source:
                q = chances(counts[lang, other])
                values["pair"].append((other, sum(apart(p[t], q[t]) for t in kept)))
        values["term"] = [(t, apart(p[t], everything[t])) for t in kept if counts[lang, source][t] and p[t] > everything[t]]
        for part, items in values.items():
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: top if part == "term" else None]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def found(table):
    rows = [tuple(r) for r in table.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_equals_its_definition_in_small_blocks_and_tiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    audit = divergence.divergence_audit(docs.repartition(7), least_documents=3, top=4, term_block=50, source_tile=3)
    assert found(audit) == plain_audit(rows, 3, 4)


def test_audit_on_odd_rows(spark, tiny):
    docs = tiny.selectExpr("text", "CASE WHEN doc_id < 7 THEN 'en' WHEN doc_id < 9 THEN '' END AS lang", "source", "id AS item", "score AS rank", "1 AS value", "2 AS n", "3 AS term")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least in (1, 2, 100):  # with 100 no language keeps a term: pairs are there, all at zero
        expected = plain_audit(rows, least, 10)
        assert found(divergence.divergence_audit(docs, least_documents=least)) == expected
        assert any(r[2] == "pair" for r in expected) and (least == 100) == (not any(r[2] == "term" for r in expected))
    assert divergence.divergence_audit(empty(docs)).count() == 0


def test_case_of_letters_beyond_ascii_stays():
    assert divergence.terms_of("ÀB c\u0085d_E9f\x00日本, X") == ["Àb".encode(), "c\u0085d".encode(), b"e", b"f", "日本".encode(), b"x"]


def test_skyband_keeps_what_fewer_than_k_dominate():
    random = np.random.default_rng(5)
    for k in (1, 3, 10):
        n, lang_n = random.integers(1, 8, 300), random.integers(5, 14, 300)
        names = [f"t{i:03}" if i % 3 else f"é{i}" for i in random.permutation(300)]
        kept = set(divergence._skyband(n, lang_n, pa.array(names), k).tolist())
        key = [x.encode() for x in names]
        dominators = [sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and key[j] < key[i] for j in range(300)) for i in range(300)]
        assert kept == {i for i in range(300) if dominators[i] < k}


def test_partial_skybands_merge_to_the_skyband_of_all():
    random = np.random.default_rng(6)
    rows = pa.table({
        "lang": ["a"] * 400, "source": [f"s{i % 2}" for i in range(400)], "term": [f"t{i}" for i in random.permutation(400)],
        "n": random.integers(1, 9, 400), "lang_n": random.integers(9, 30, 400),
    })
    band = divergence._partition_skybands(3)

    def run(tables):
        return [b for t in tables for b in band(iter(t.to_batches()))]

    parts = pa.Table.from_batches(run([rows.slice(0, 150), rows.slice(150, 150), rows.slice(300)]))
    merged, whole = pa.Table.from_batches(run([parts])), pa.Table.from_batches(run([rows]))
    assert sorted(merged["term"].to_pylist()) == sorted(whole["term"].to_pylist())
