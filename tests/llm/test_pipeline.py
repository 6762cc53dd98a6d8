from __future__ import annotations

import xxhash

import corpus_pipeline
from eventloom.session import fresh_path
from tests.llm.conftest import SF, empty
from tests.llm.test_text_scans import plain
from tests.llm.test_tokens import check_pieces


def print_of(text):
    """SimHash of all four-word shingles, bit by bit."""
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    text = " ".join(f"w{i}" for i in range(500))
    rows = [(1, text, 0, 1), (5, text + " z", 0, 2), (5, "some other text with no copy anywhere", 0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone_id int")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r.gone_id for r in left.collect()) == [1, 3]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    raw, mild, lines, single, clean = rows
    assert set(raw) > set(mild) >= set(lines) >= set(single) == set(clean)

    # Lines: no long line twice, and what is left stands in the text before.
    seen = [line for t in lines.values() for line in t.split("\n") if len(line.split()) > 5]
    assert len(seen) == len(set(seen))
    assert all(set(t.split("\n")) <= set(mild[d].split("\n")) for d, t in lines.items())

    # Near copies: fingerprints link at four bits, and of each group the first id stays.
    prints = {d: print_of(t) for d, t in lines.items()}
    root = {d: d for d in lines}
    for a in sorted(lines):
        for b in lines:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert set(single) == {d for d, r in root.items() if r == d}

    # Secrets: replaced, and nothing else touched.
    assert any(plain(t) for t in single.values()) and not any(plain(t) for t in clean.values())
    assert all(clean[d] == t for d, t in single.items() if not plain(t))
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())

    expected, packed = check_pieces(kept[5].collect(), clean, 4096)
    assert expected == packed


def test_run_gives_the_last_stage(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and pieces.count() > 0


def test_stages_on_odd_rows_and_none(spark, tiny):
    docs = tiny.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", "id")
    for rows in (docs, empty(docs)):
        table = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            path = fresh_path(spark, "odd")
            stage(spark, table, SF).write.parquet(path)
            table = spark.read.parquet(path)
            assert table.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() >= 0
    assert table.count() == 0
