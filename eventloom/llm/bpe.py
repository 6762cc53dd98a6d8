"""BPE encoding and decoding with batched merge rounds in numpy.

Symbols of many words lie in one flat array. Each round finds, for every word,
its lowest-ranked pair in a table by hash of the pair keys, and merges all
places of that pair at once; finished words leave the array. Chunks of text that
tokenise alone (white space and the word after it) are kept by task, so that a
frequent chunk is merged once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from eventloom.llm.batches import short_batches, text_rows

# Chunks whose ids one Python worker keeps; beyond that it drops the later half, since frequent chunks come early.
CACHE_CHUNKS = 300_000
# Characters up to here are classed alike by all Unicode versions in use; others go to the library's own splitter.
LATIN_END = "\u024f"
_BEYOND_LATIN = re.compile(f"[^\0-{LATIN_END}]")
MARKS = frozenset(".,;:!?|*$%&#")
# Marks at the end of a chunk, after a letter or digit of Latin texts: no pattern takes them together with what is before them.
_LAST_MARKS = re.compile(r"([.,;:!?|*$%&#](?<=[^\W_].)[.,;:!?|*$%&#]*)(?![^ \t\n\r])")
NO_RANK = np.int32(2**31 - 1)
SLOT_BITS, SEVERAL = 20, -2  # slots of pairs by hash; those of several pairs say so, and these are searched for in order
# White space as the tokenizers' patterns see it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The word patterns of the two byte-level tokenizers.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE model read from a tokenizers JSON file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_characters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 32 | right
        keys, first = np.unique(keys[::-1], return_index=True)  # of a pair listed twice the later counts
        order = len(merges) - 1 - first
        self.pair_keys, self.pair_ranks, self.pair_made = keys, order.astype(np.int32), made[order]
        slots = self._slot(keys)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slots] = np.arange(len(keys))
        self.slots[np.bincount(slots, minlength=1 << SLOT_BITS) > 1] = SEVERAL
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        byte = {c: b for b, c in enumerate(letters)}
        size = max(max(vocab.values()), *self.special.values()) + 1
        self.bytes = [b""] * size
        for text, i in vocab.items():
            if text not in self.special:
                self.bytes[i] = bytes(byte[c] for c in text.removesuffix(self.suffix))
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.lower = spec["normalizer"] is not None
        if self.lower:  # white space only separates, so chunks are what stands between it
            self._words, self._chunk = regex.compile(PLAIN_WORDS), None
        else:
            self._words, self._chunk = regex.compile(SPACED_WORDS), re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._library = None
        self._content = content
        self.cache: dict = {}

    def split(self, text: str) -> list:
        """Chunks whose ids depend on nothing beside them."""
        if self._chunk is not None:
            return self._chunk.findall(text)
        # Letters of Latin scripts lower alike here and there, and so do fewer chunks need merging.
        if text.isascii() or not _BEYOND_LATIN.search(text):
            text = _LAST_MARKS.sub(r" \1", text.lower())
        return text.encode().split()

    def words(self, chunk: str | bytes) -> list:
        """The words of a chunk, as the tokenizer's patterns cut them, in the chunk's type."""
        text = chunk.decode() if self.lower else chunk
        if text.isascii() or not _BEYOND_LATIN.search(text):
            text = text.lower() if self.lower else text
            start = 1 if text[0] == " " else 0
            if text[start:].isalpha():  # most chunks are a word and perhaps a mark
                found = [text]
            elif text[-1] in MARKS and text[start:-1].isalpha():
                found = [text[:-1], text[-1]]
            else:
                found = self._words.findall(text)
        else:
            if self._library is None:
                whole = Tokenizer.from_str(self._content.decode())
                self._library = (whole.normalizer, whole.pre_tokenizer, {c: b for b, c in enumerate(_byte_characters())})
            normalizer, splitter, byte = self._library
            text = normalizer.normalize_str(text) if normalizer else text
            found = [bytes(byte[c] for c in word).decode() for word, _ in splitter.pre_tokenize_str(text)]
        return [w.encode() for w in found] if self.lower else found

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and its place in the table; NO_RANK where it is none."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slots[self._slot(keys)]
        if (several := at == SEVERAL).any():
            at[several] = np.minimum(np.searchsorted(self.pair_keys, keys[several]), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK), at

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none empty), as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[bytes] = [b""] * len(words)
        ranks, places = self._pairs(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NO_RANK
            if over.any():
                self._finish(done, symbols, owner, starts[over], sizes[over])
                keep = np.repeat(~over, sizes)
                symbols, owner, ranks, places = symbols[keep], owner[keep], ranks[keep], places[keep]
                lowest, sizes = lowest[~over], sizes[~over]
            if not len(symbols):
                break
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            new_run = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]  # aaa merges at its first a
            symbols[at] = self.pair_made[places[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols are afterwards
            symbols, owner, ranks, places = symbols[keep], owner[keep], ranks[keep], places[keep]
            near = np.zeros(len(symbols), bool)
            near[moved] = True
            near[np.maximum(moved - 1, 0)] = True
            stale = np.flatnonzero(near)
            ranks[stale], places[stale] = self._pairs(symbols, owner, stale)
        return done

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbols) - 1)
        ranks, places = self._ranks(symbols[at], symbols[after])
        ranks[(after == at) | (owner[after] != owner[at])] = NO_RANK
        return ranks.astype(np.int32), places

    @staticmethod
    def _finish(done: list[bytes], symbols: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        raw = symbols.astype("<u4").tobytes()
        for word, start, size in zip(owner[starts].tolist(), starts.tolist(), sizes.tolist(), strict=True):
            done[word] = raw[4 * start : 4 * (start + size)]

    def learn(self, fresh: set) -> None:
        """Put the ids of unseen chunks into the cache, merging all their new words together; a word is a chunk too."""
        cache, parts = self.cache, []
        new: dict = {}
        if self.lower:  # most chunks are a word in lower case already
            texts = b"\n".join(fresh).decode().split("\n")  # in the same order
            words = {c for c, t in zip(fresh, texts, strict=True) if t.isalpha() and t.islower() and (t.isascii() or not _BEYOND_LATIN.search(t))}
            new = dict.fromkeys(words)
            fresh = fresh - words
        for chunk in fresh:
            words = self.words(chunk)
            if len(words) != 1 or words[0] != chunk:
                parts.append((chunk, words))
            for word in words:
                if word not in cache:
                    new[word] = None
        words = list(new)
        ids = self.merge(words if self.lower else [w.encode() for w in words])
        cache.update(zip(words, ids, strict=True))
        for chunk, words in parts:
            cache[chunk] = b"".join([cache[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text become their ids."""
        pieces = []
        for text in texts:
            if any(s in text for s in self.special):
                parts = self._special.split(text)
                pieces.append([self.special[p] if k % 2 else self.split(p) for k, p in enumerate(parts)])
            else:
                pieces.append([self.split(text)])
        if len(self.cache) > CACHE_CHUNKS:
            self.cache = dict(islice(self.cache.items(), CACHE_CHUNKS // 2))
        cache = self.cache
        fresh = set().union(*(p for parts in pieces for p in parts if not isinstance(p, int))).difference(cache)
        if fresh:
            self.learn(fresh)
        out = []
        get = cache.__getitem__
        for parts in pieces:
            raw = [p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts]
            out.append(raw[0] if len(raw) == 1 else b"".join(raw))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def loader(spark: SparkSession, path: str) -> Callable[[], Vocabulary]:
    """A function for tasks that gives the vocabulary; its file is read on the driver and sent once."""
    with open(path, "rb") as file:
        content = file.read()
    sent = spark.sparkContext.broadcast(content)
    mark = zlib.crc32(content)

    def load() -> Vocabulary:
        if mark not in _LOADED:
            _LOADED[mark] = Vocabulary(sent.value)
        return _LOADED[mark]

    return load


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` for every row: ids as little-endian unsigned 32-bit integers, and the text they decode to.

    Ids are those of the tokenizers library for the file at ``path`` without added
    special tokens. Null and empty texts have no ids and decode to an empty text.
    Texts are read whole, in batches of a few hundred; ids of a row that has
    no id are given too. Repeated rows stay repeated, other columns are
    ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    load = loader(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load()
        for batch in batches:
            ids = vocabulary.encode(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array(ids, pa.binary()), pa.array(map(vocabulary.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"])

    return text_rows(docs, id_column, text_column).mapInArrow(run, "id long, ids binary, decoded string")
