from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm import bpe, packing
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SF, empty

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = ["a", "B", "the", " ", "  ", "\n", "é", "É", "1", "23", ".", "!!", "'s", "ß", "\t", "中", "é", "_", "-", "İ", "²", "Σ", "<|endoftext|>", "<|startoftext|>"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("file", FILES)
def test_ids_and_texts_equal_the_library(file):
    with open(public_tokenizers.path(file), "rb") as handle:
        content = handle.read()
    own, library = bpe.Vocabulary(content), Tokenizer.from_str(content.decode())
    rng = random.Random(1)
    texts = ["", " ", "a" * 3000, "don't WE'LL", "\r\n\r\n a", "🙂👍🏽", *(f"a{chr(c)}b{chr(c)} c" for c in [*range(0x250), *range(0x2000, 0x2030), 0x3000])]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(1500)]
    coded = own.encode(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(c) for c in coded] == expected
    if file == FILES[0]:
        assert [own.decode(c) for c in coded] == [library.decode(e, skip_special_tokens=False) for e in expected]


@pytest.mark.parametrize("file", FILES)
def test_marks_around_words_equal_the_library(file):
    """Trailing marks are cut from Latin words before the patterns see them; none may move over a border."""
    with open(public_tokenizers.path(file), "rb") as handle:
        content = handle.read()
    own, library = bpe.Vocabulary(content), Tokenizer.from_str(content.decode())
    rng = random.Random(2)
    around = [*".,;:!?|*$%&#'\"-_()«× \t\n\x0b\x1c\x85\xa0", "'s", "'ll", "...", " "]
    inside = ["ab", "É", "ñ", "ª", "²", "¼", "7", "ǅ", "中", ""]
    texts = ["".join(rng.choice(rng.choice((around, inside))) for _ in range(rng.randrange(1, 16))) for _ in range(4000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids(c) for c in own.encode(texts)] == expected


def test_a_full_cache_changes_nothing(monkeypatch):
    with open(public_tokenizers.path(FILES[0]), "rb") as handle:
        own = bpe.Vocabulary(handle.read())
    texts = [f"word{i} other{i * 7}, and" for i in range(200)]
    whole = own.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 10)
    assert [own.encode([t])[0] for t in texts] == whole


def test_round_trip_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    found = {r.doc_id: r for r in QUERIES["op3_bpe_round_trip"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        coded = library.encode(row.text or "", add_special_tokens=False).ids
        assert found[row.doc_id].n_tokens == len(coded)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(np.array(coded, "<u4").tobytes()).hexdigest()
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_encoding_odd_rows(spark, tiny):
    found = bpe.encode(tiny, public_tokenizers.path(FILES[0])).collect()
    assert len(found) == 11 and {len(r.ids) for r in found if r.id in (3, 4)} == {0}
    texts = {r.doc_id: r.text or "" for r in tiny.collect()}
    assert all(r.decoded == texts[r.id] for r in found)
    assert bpe.encode(empty(tiny), public_tokenizers.path(FILES[0])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_mixture_fills_every_window_and_keeps_its_targets(seed):
    rng = random.Random(seed)
    queues = [[rng.randint(1, rng.choice([3, 50, 400])) for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(1, 7))]
    sizes = [sum(q) for q in queues]
    weights = sizes if seed % 2 else [rng.randint(0, 50) for _ in queues]
    window = rng.choice([8, 64, 100])
    mixture, filled = packing.Mixture(sizes, weights), {}
    for queue, documents in enumerate(queues):
        place = 0
        for tokens in documents:
            pieces = packing.cut(mixture, queue, place, tokens, window)
            assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) == tokens
            for _, length, sequence, offset in pieces:
                for i in range(offset, offset + length):
                    assert filled.setdefault((sequence, i), queue) == queue and length > 0
            place += tokens
    assert len(filled) == sum(sizes) and set(filled) == {divmod(i, window) for i in range(sum(sizes))}
    if seed % 2 and sum(sizes):
        for w in range(sum(sizes) // window):
            for queue, size in enumerate(sizes):
                got = sum(filled[w, i] == queue for i in range(window))
                assert abs(got - window * size / sum(sizes)) <= 4


def check_pieces(found, texts, size):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    coded = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    for r in found:
        assert zlib.crc32(coded[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(coded[r.doc_id])
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = []
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        lengths.append(end)
    assert max(lengths) <= size and sum(n < size for n in lengths) <= 1
    return sum(map(len, coded.values())), sum(lengths)


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected, packed = check_pieces(QUERIES["op4_mixture_packing"](spark, SF).collect(), docs, 4096)
    assert expected == packed


def test_packing_odd_rows_and_weights(spark, tiny):
    path = public_tokenizers.path(FILES[1])
    found = packing.pack(tiny, path, size=64, weights={"a": 3, None: 1}).collect()
    total = sum(r.length for r in found)
    assert sorted((r.id or 0, r.length) for r in found if r.tokens == 1) == [(3, 1), (4, 1), (5, 1)]
    assert {(r.sequence, r.offset + i) for r in found for i in range(r.length)} == {divmod(i, 64) for i in range(total)}
    assert all(len(r.ids) == 4 * r.length for r in found)
    assert packing.pack(empty(tiny), path).count() == 0


def test_ranks_of_pairs_that_share_a_slot(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        content = file.read()
    usual = bpe.Vocabulary(content)
    left, right = np.divmod(usual.pair_keys, 1 << 32)
    monkeypatch.setattr(bpe, "SLOT_BITS", 12)
    crowded = bpe.Vocabulary(content)
    assert (crowded.slots == bpe.SEVERAL).sum() > 4000 > (usual.slots == bpe.SEVERAL).sum() > 0
    for vocabulary, bits in ((usual, 20), (crowded, 12)):
        monkeypatch.setattr(bpe, "SLOT_BITS", bits)
        assert (vocabulary._ranks(left, right)[0] == vocabulary.pair_ranks).all()
        known = np.isin(right << 32 | left, usual.pair_keys)
        assert ((vocabulary._ranks(right, left)[0] != bpe.NO_RANK) == known).all()
