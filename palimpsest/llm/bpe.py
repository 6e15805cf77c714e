"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A piece of text starts as one symbol a byte. The tree's leaves hold the rank of the pair that starts at
each symbol, its root the lowest rank and, of equal ones, the leftmost. That pair is merged and three
leaves change, each in logarithmic time, until no pair is left that merges.

The rules around it (normal form, lower case, pieces, special tokens, word ends) are those that the
vocabulary file states. They never look across ASCII white space, so words are encoded one by one, and
each process keeps the words it met, in two generations of bounded size.

Defined results: a null text counts as empty, which has no ids and decodes to an empty text; a null
doc_id and repeated rows are kept as they are; an empty table gives no rows; other columns are left out
whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.common import by_batch, text_or_empty, word_lists

#: Words in one generation of a process's cache, and the bytes of a word that is kept at most.
CACHE_WORDS, CACHE_BYTES = 300_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or from U+0100 on those that have none."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def piece_pattern(spec: dict) -> regex.Pattern:
    """What a tokenizer file cuts texts into."""
    return regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))


def normal(text: str) -> str:
    """Normal form C, then lower case character by character."""
    return text.lower() if text.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class Vocabulary:
    """What a tokenizer file states, and the encoding of pieces and words by it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.inner = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + self.suffix] for c in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.piece = piece_pattern(spec)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one piece, given as UTF-8."""
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        tree, made = [none] * (2 * size), [0] * n
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                tree[size + i], made[i] = m[0] << 32 | i, m[1]
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != none:
            i = best & 0xFFFFFFFF
            gone = after[i]
            ids[i], ids[gone] = made[i], -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
            left = before[i]
            for at, value in ((gone, none), (i, none if right >= n else self.rank(ids, made, i, right)), *(((left, self.rank(ids, made, left, i)),) if left >= 0 else ())):
                at += size
                if tree[at] != value:
                    tree[at] = value
                    at >>= 1
                    while at:
                        a, b = tree[2 * at], tree[2 * at + 1]
                        value = a if a < b else b
                        if tree[at] == value:
                            break
                        tree[at] = value
                        at >>= 1
        return [x for x in ids if x >= 0]

    def rank(self, ids: list[int], made: list[int], i: int, j: int) -> int:
        """The leaf of the pair at symbols i and j."""
        if m := self.merges.get((ids[i], ids[j])):
            made[i] = m[1]
            return m[0] << 32 | i
        return 1 << 62

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(word) if "<" in word else (word,):
            if (i := self.special.get(part)) is not None:
                out.append(i)
                continue
            for p in self.piece.findall(normal(part)):
                if (got := self.pieces.get(p)) is None:
                    got = tuple(self.merge(p.encode()))
                    if len(p) <= CACHE_BYTES:
                        if len(self.pieces) >= CACHE_WORDS:
                            self.pieces.clear()
                        self.pieces[p] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by a space: the file states no decoder."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


class Words(dict):
    """(ids as little-endian 32-bit integers, decoded text) of each word met, in two generations."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, word: bytes) -> tuple[bytes, bytes]:
        if (got := self.old.get(word)) is None:
            ids = self.vocabulary.encode_word(word.decode())
            got = (np.array(ids, "<i4").tobytes(), self.vocabulary.decode(ids).encode())
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


@cache
def words_of(path: str) -> Words:
    """One a process: tasks that it runs later find the words of earlier ones."""
    return Words(Vocabulary(path))


def encode_text(words: Words, raw: bytes) -> tuple[bytes, bytes]:
    """The ids of a whole text as 32-bit integers, and the text that they decode to."""
    ids, texts = [], []
    for some in word_lists(raw):
        got = [g for g in map(words.__getitem__, some) if g[0]]
        ids.append(b"".join([g[0] for g in got]))
        texts += [g[1] for g in got]
    return b"".join(ids), b" ".join(texts)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string): each whole text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in batches:
            got = [encode_text(words, t.as_buffer().to_pybytes()) for t in b.column(1)]
            ids = np.frombuffer(b"".join([g[0] for g in got]), "<i4")
            at = np.cumsum([0] + [len(g[0]) // 4 for g in got]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, ids), pa.array([g[1] for g in got], pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return by_batch(docs.select("doc_id", text_or_empty()), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
