"""Token ids in files of length-delimited binary records, with an offset index beside each file.

A record is, little-endian: the payload's length (8 bytes), the masked CRC-32 of these 8 bytes (4), the
payload, and the payload's masked CRC-32 (4). A payload is a flag (1 if there is a doc_id), the doc_id
(8 bytes), the width of an id in bytes (1), and the ids. A file's index has of each of its records the
offset, the length, and the number of ids before it in the file (8 bytes each), so that any record is read alone, in
any order; records are read back by the index in a seeded shuffle. Documents lie in ascending doc_id order over the files
in order of their numbers. A file is written under a name of its own attempt and then renamed, so a task that runs
again, or twice, leaves the same one file, and one that fails leaves none.

The library's model gives the ids of each piece of a word that a process has not met. Normal form and pieces are made here as
the vocabulary file states them, since the library takes three times as long for whole texts (976 s a GB against 286,
one core), and twice as long (500 to 590) if it gets just the new words, many at a time.

The checksum is CRC-32 as in zlib, masked by a rotation and an added constant, so that a checksum of
data that holds checksums stays sound.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come first; rows
that share a doc_id are ordered by their text's hash, and repeated rows are all written; an empty table
gives no rows; other columns are left out whatever their names.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm.common import by_batch, cut, own_folder, text_or_empty, word_lists
from palimpsest.sources.objects import replaced, store

#: Words that a process keeps in one of two generations, and the bytes of a word that is kept at most.
CACHE_WORDS, CACHE_BYTES = 300_000, 64
MASK = 0xA282EAD8
HEAD, FOOT, PAYLOAD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqB"), struct.Struct("<QQQ")
#: Rows of the table that make one file, so that a file stays some tens of MB.
FILE_ROWS = 8192


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + FOOT.pack(masked(payload))


def unframed(read) -> bytes | None:
    """The next payload, checked; None at the end."""
    if not (head := read(HEAD.size)):
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise ValueError("damaged record: its length does not match its checksum")
    payload = read(size := HEAD.unpack(head)[0])
    if len(payload) < size or read(FOOT.size) != FOOT.pack(masked(payload)):
        raise ValueError("damaged record: its payload does not match its checksum")
    return payload


def entry(offset: int, size: int, before: int) -> bytes:
    return ENTRY.pack(offset, size, before)


def packed(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return PAYLOAD.pack(doc_id is not None, doc_id or 0, width) + ids


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = PAYLOAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size)


class Encoder(dict):
    """The ids of each word met as the library gives them, little-endian, in two generations of bounded size.

    The file's rules never look across ASCII white space, so a text's ids are those of its words. A word is
    put in normal form and cut into pieces here, and the library's model encodes each piece that is new; words with a special
    token go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old, self.pieces = Tokenizer.from_file(path), {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.width = self.tokenizer.model, 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut, self.special = bpe.piece_pattern(spec), [t["content"] for t in spec["added_tokens"]]
        self.symbols = dict(enumerate(bpe.byte_symbols()))

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        if "<" in text and any(t in text for t in self.special):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out = []
        for piece in self.cut.findall(bpe.normal(text)):
            if (got := self.pieces.get(piece)) is None:
                symbols = piece.encode().decode("latin-1").translate(self.symbols)
                got = self.packed([t.id for t in self.model.tokenize(symbols)])
                if len(piece) <= CACHE_BYTES:
                    if len(self.pieces) >= CACHE_WORDS:
                        self.pieces.clear()
                    self.pieces[piece] = got
            out.append(got)
        return b"".join(out)

    def __missing__(self, word: bytes) -> bytes:
        if (got := self.old.get(word)) is None:
            got = self.encoded(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, raw: bytes) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, words)) for words in word_lists(raw)])


@cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes the files, and returns file, docs, ids: what each holds, a row a file."""
    n = max(1, -(-docs.count() // file_rows))
    order = ["doc_id", F.xxhash64("text")]  # rows that share an id are many files' work as well
    ordered = docs.select("doc_id", text_or_empty()).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (to, at) = encoder(path), store(folder)
        context = TaskContext.get()
        k, attempt = context.partitionId(), context.taskAttemptId()
        end = b"" if end_id is None else words.packed([end_id])
        to.create_dir(at, recursive=True)
        name, own = f"{at}/part-{k:06d}", f"{at}/_attempt-{k:06d}-{attempt}"
        n_docs = n_ids = offset = 0
        try:
            with to.open_output_stream(f"{own}.rec") as out, to.open_output_stream(f"{own}.idx") as index:
                for b in batches:
                    for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        ids = words.encode(text.as_buffer().to_pybytes()) + end
                        record = framed(packed(doc_id, ids, words.width))
                        out.write(record)
                        index.write(entry(offset, len(record), n_ids))
                        offset, n_docs, n_ids = offset + len(record), n_docs + 1, n_ids + len(ids) // words.width
            for kind in ("rec", "idx"):
                replaced(to, f"{own}.{kind}", f"{name}.{kind}")
        except BaseException:
            for kind in ("rec", "idx"):
                with contextlib.suppress(OSError):
                    to.delete_file(f"{own}.{kind}")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, n_docs, n_ids)], ["file", "docs", "ids"])

    return cut(by_batch(ordered, run, "file long, docs long, ids long"))


def read_all(folder: str, files: DataFrame, as_bytes: bool = False, seed: int = 42) -> DataFrame:
    """doc_id, start, ids of every record, each found by the index, in a shuffle of its file's records. files: file, and ids that it holds; start counts the ids of all records before. ids: an array of int, or little-endian unsigned 32-bit integers as bytes."""
    n = files.count()
    based = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frm, at = store(folder)
        for b in batches:
            for k, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with frm.open_input_file(f"{at}/part-{k:06d}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)
                rows, held = [], 0
                with frm.open_input_file(f"{at}/part-{k:06d}.rec") as f:
                    for i in np.random.default_rng([seed, k]).permutation(len(index)).tolist():
                        doc_id, ids = record_at(f, *index[i, :2].tolist())
                        rows.append((doc_id, base + int(index[i, 2]), ids))
                        held += len(ids)
                        if held > 1 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        if as_bytes:
            ids = pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())
        else:
            at = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(at, np.concatenate([r[2].astype(np.int32) for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids], ["doc_id", "start", "ids"])

    return by_batch(based.repartitionByRange(max(1, n), "file"), run, f"doc_id long, start long, ids {'binary' if as_bytes else 'array<int>'}")


def record_at(f, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """The record that an index says is there, checked."""
    raw = io.BytesIO(f.read_at(size, offset))
    payload = unframed(raw.read)
    if payload is None or raw.read(1):
        raise ValueError("damaged index: no record of its length there")
    return unpacked(payload)


def read_one(folder: str, file: int, k: int) -> tuple[int | None, list[int]]:
    """Record k of a file, found by its index and read alone: doc_id and ids."""
    frm, at = store(folder)
    with frm.open_input_file(f"{at}/part-{file:06d}.idx") as index:
        offset, size, _ = ENTRY.unpack(index.read_at(ENTRY.size, k * ENTRY.size))
    with frm.open_input_file(f"{at}/part-{file:06d}.rec") as f:
        doc_id, ids = record_at(f, offset, size)
    return doc_id, ids.tolist()


def written_and_read(docs: DataFrame, path: str, end_id: int | None = 2, folder: str = "", file_rows: int = FILE_ROWS, as_bytes: bool = False) -> DataFrame:
    """doc_id, start, ids of every document, from the files that it has just been written to."""
    folder = folder or own_folder(docs.sparkSession, "records")
    return read_all(folder, write(docs, path, folder, end_id, file_rows), as_bytes)
