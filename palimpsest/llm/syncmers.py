"""Document fingerprints from closed syncmers.

A run of `k` code points is a closed syncmer if the smallest hash among its inner runs of `s` code points
lies at its first or its last place. Whether a run is one depends on that run alone, so the same passage
gives the same anchors wherever it stands: the anchors of an edited text are those of its parts, and of
the few runs across each joint. A text's fingerprint is the `size` smallest different hashes of its
anchors (all of them where there are fewer), each as 8 hex digits; the likeness of two fingerprints is
the share of their union's smallest hashes that both hold, an estimate of the Jaccard likeness of the
texts' anchors, exact for short texts.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, which is like
another empty one (1.0) and like no other (0.0); a text without a closed syncmer, as all of fewer than k
code points are, has one anchor, its whole; equal texts have equal fingerprints. Documents follow one another by descending doc_id, null last,
rows that share an id by their text's hash; the first follows the last, so a single document follows
itself. An empty table gives no rows; other columns are left out whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_batch, cut, text_or_empty

K, S, SIZE = 24, 8, 128
#: Code points hashed at once, so that a very long text needs little memory.
PART = 1 << 18


class Anchors(NamedTuple):
    """Closed syncmers; whole is the hash of a text without any."""

    at: np.ndarray
    hashes: np.ndarray
    whole: np.ndarray = np.empty(0, np.uint32)

    def or_whole(self) -> Anchors:
        return self if len(self.at) else Anchors(np.zeros(len(self.whole), np.int64), self.whole)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` code points."""
    out = np.zeros(len(points) - width + 1, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[j : len(points) - width + 1 + j]
    return mixed(out)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def whole_hash(text: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(text.encode(), digest_size=4).digest(), np.uint32)


def anchors(text: str, k: int = K, s: int = S) -> Anchors:
    """Where the text's closed syncmers start, and their 32-bit hashes."""
    n = len(text)
    if n < k:
        return Anchors(np.zeros(min(n, 1), np.int64), whole_hash(text) if n else np.empty(0, np.uint32))
    ats, hashes = [], []
    for start in range(0, n - k + 1, PART):
        inner = run_hashes(code_points(text[start : start + PART + k - 1]), s)
        width = k - s + 1
        low, count = window_min(inner, width), len(inner) - width + 1
        at = np.flatnonzero((low == inner[:count]) | (low == inner[width - 1 :]))
        h = np.zeros(len(at), np.uint64)
        for j in [*range(0, k - s + 1, s), *([k - s] if (k - s) % s else [])]:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + inner[at + j])
        ats.append(at + start)
        hashes.append((h >> np.uint64(32)).astype(np.uint32))
    found = Anchors(np.concatenate(ats), np.concatenate(hashes))
    return found if len(found.at) else found._replace(whole=whole_hash(text))


def edited_text(text: str, other: str) -> tuple[str, int, int]:
    """The text whose last half is replaced by as much of the other's start; how much is kept of each."""
    half = len(text) // 2
    taken = min(half, len(other))
    return text[: len(text) - half] + other[:taken], len(text) - half, taken


def edited_anchors(a: Anchors, b: Anchors, edited: str, kept: int, taken: int, sizes: tuple[int, int], k: int = K, s: int = S) -> Anchors:
    """The anchors of an edited text, from those of its two parts and the runs across their joint."""
    if kept < k or taken < k or min(sizes) < k:
        return anchors(edited, k, s)
    first, last = a.at <= kept - k, b.at <= taken - k
    joint = anchors(edited[kept - k + 1 : kept + k - 1], k, s)
    return Anchors(np.concatenate([a.at[first], joint.at + kept - k + 1, b.at[last] + kept]), np.concatenate([a.hashes[first], joint.hashes, b.hashes[last]]))


def sketch(found: Anchors, size: int = SIZE) -> np.ndarray:
    return np.unique(found.or_whole().hashes)[:size]


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the smallest hashes of the union that are in both; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:size] == 2).mean())


def with_anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id and anchors: an array of (at, hash) of each whole text, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(t, k, s).or_whole() for t in b.column(1).to_pylist()]
            at = np.cumsum([0] + [len(f.at) for f in found]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([np.concatenate([f.at for f in found]).astype(np.int64), np.concatenate([f.hashes for f in found]).astype(np.int64)], ["at", "hash"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pairs)], ["doc_id", "anchors"])

    return by_batch(docs.select("doc_id", text_or_empty()), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, anchors array<struct<at: long, hash: long>>")


def bucket_of(place: Column, heads: list[tuple], kind: str) -> Column:
    """How many of the heads but the first, in falling order, come at or before a place: a binary search."""
    text = json.dumps([{"doc_id": d, "h": h} for d, h in heads[1:]])
    bounds = F.from_json(F.lit(text), f"array<struct<doc_id: {kind}, h: long>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(heads).bit_length()))])
    there = lambda n: (n <= len(heads) - 1) & (F.get(bounds, F.least(n, F.lit(len(heads) - 1)) - 1) >= place)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(there(n + step), n + step).otherwise(n))


def in_succession(docs: DataFrame, rows: int = 4096, most_buckets: int = 20_000) -> DataFrame:
    """bucket, guest, doc_id, h, text: buckets of neighbouring documents, in order, each with a guest after its last: the first document of the next bucket.

    Ids and the hashes of texts alone are dealt by ranges first, so that rows which share an id fall into several buckets. What the
    driver holds is a head a bucket, `most_buckets` at most. Texts move once, and only one text a bucket is read a second time.
    """
    ids = docs.select("doc_id", text_or_empty()).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = min(most_buckets, max(1, -(-docs.count() // rows)))
    ranges = cut(ids.select("doc_id", "h").repartitionByRange(n, F.desc_nulls_last("doc_id"), F.desc("h")).withColumn("part", F.spark_partition_id()))
    heads = [tuple(r["head"]) for r in ranges.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()]
    if not heads:
        return ids.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "doc_id", "h", "text")
    placed = ids.withColumn("bucket", bucket_of(F.struct("doc_id", "h"), heads, kind) if len(heads) > 1 else F.lit(0))
    after = [(i, *heads[(i + 1) % len(heads)]) for i in range(len(heads))]
    guests = docs.sparkSession.createDataFrame(after, f"bucket int, _id {kind}, _h long")
    guests = ids.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    names = ["bucket", "guest", "doc_id", "h", "text"]
    both = placed.withColumn("guest", F.lit(False)).select(names).union(guests.withColumn("guest", F.lit(True)).select(names))
    return both.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("h"))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Of each document: doc_id, n_chars, edited (its text, the last half replaced by the next document's start), fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before = None, None
        for b in batches:
            out = []
            for at, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at == bucket and before is None:  # a row like the guest, again
                    continue
                found = anchors(text, k, s)
                now = (doc_id, text, found, sketch(found, size))
                if at == bucket:
                    out.append(compared(before, now))
                bucket, before = at, None if guest else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def compared(a: tuple, b: tuple) -> tuple:
        edited, kept, taken = edited_text(a[1], b[1])
        other = sketch(edited_anchors(a[2], b[2], edited, kept, taken, (len(a[1]), len(b[1])), k, s), size) if edited != a[1] else a[3]
        return a[0], len(a[1]), edited, as_text(a[3]), as_text(other), likeness(a[3], other, size), likeness(a[3], b[3], size)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int32() if kind == "int" else pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return by_batch(in_succession(docs).select("bucket", "guest", "doc_id", "text"), run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
