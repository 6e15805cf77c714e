"""Rows packed into bundles, and bundles unpacked into rows."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator

import lzma

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import containers, encodings, formats
from palimpsest.runtime import ship

#: Python's names of the encodings in which a leaf can be written.
ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "utf-16", "utf-32-le", "utf-32-be", "utf-32", "latin-1")


def compressed(kind: str, data: bytes) -> bytes:
    if kind == "gzip":
        return gzip.compress(data, mtime=0)
    if kind == "zlib":
        return zlib.compress(data)
    if kind == "xz":
        return lzma.compress(data)
    if kind == "zstd":
        return zstandard.ZstdCompressor().compress(data)
    return data


def archived(kind: str, members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members:
                z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    else:
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def packed(data: list[tuple[str, bytes]], layers: list[str]) -> bytes:
    """Members through layers from the inside out, such as tar, gzip; without an archive there is one member."""
    blob = data[0][1] if data else b""
    for i, kind in enumerate(layers):
        if kind in ("tar", "zip"):
            blob = archived(kind, data if i == 0 else [(f"inner-{i}", blob)])
        else:
            blob = compressed(kind, blob)
    return blob


def leaves(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The leaves of a bundle, by the formats that it shows."""
    kind = formats.detect(data[: formats.HEAD])
    try:
        if kind in ("zip", "tar"):
            members = (containers.read_zip if kind == "zip" else containers.read_tar)(data, 1 << 40, 1 << 40)
            inner = [(f"{path}!{m.name}", m.body) for m in members if m.regular]
        elif kind in formats.WRITABLE:
            inner = [(path, containers.decompress(kind, data, 1 << 40)[0])]
        else:
            yield path, data
            return
    except containers.Refused:  # it only begins like a container: a leaf, as the walk leaves it
        yield path, data
        return
    for at, body in inner:
        yield from leaves(at, body)


def encoded(df: DataFrame, key: str, text: str, encoding: str, layers: tuple[str, ...] = ()) -> DataFrame:
    """object_key, content: an object a row, its text in an encoding, through layers of compression."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [packed([("", (t or "").encode(encoding))], list(layers)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["object_key", "content"])

    return df.select(F.col(key).cast("string").alias("object_key"), text).mapInArrow(run, "object_key string, content binary")


#: Rows and bytes that a bundle holds, but for what hashing leaves uneven.
BUNDLE_ROWS, BUNDLE_BYTES = 1000, 32 << 20


def bundled(df: DataFrame, group: str, name: str, text: str, layers: tuple[str, ...], most_rows: int = BUNDLE_ROWS, most_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """object_key, content: archives of a group's rows, by name, as many as keep each small: object_key is the group, `#` and a number.

    Text with a zero byte is written as UTF-16, since it would count as binary in UTF-8.
    """
    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((str(n), t or "") for n, t in zip(pdf["name"], pdf["text"], strict=True))
        members = [(n, t.encode("utf-16" if "\0" in t else "utf-8")) for n, t in rows]
        return pd.DataFrame({"object_key": [pdf["object_key"].iloc[0]], "content": [packed(members, list(layers))]})

    rows = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), F.col(name).cast("string").alias("name"), F.col(text).alias("text"))
    parts = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum(F.octet_length("text")) / most_bytes), F.lit(1))
    parts = rows.groupBy("group").agg(parts.cast("long").alias("parts"))
    number = F.pmod(F.xxhash64("name", "text"), F.col("parts")).cast("string")
    rows = rows.join(parts, "group").select(F.concat_ws("#", "group", number).alias("object_key"), "name", "text")
    return rows.groupBy("object_key").applyInPandas(run, "object_key string, content binary")


def contents_by(df: DataFrame, key: str, text: str, number: str, kinds: list[tuple[bytes, tuple[str, ...], bytes | None]]) -> DataFrame:
    """object_key, number, content: each row's text as the kind that its number says: (what stands before the text, layers around both, or a content of its own)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                head, layers, own = kinds[n % len(kinds)]
                data.append(own if own is not None else packed([("member", head + (t or "").encode())], list(layers)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(data, pa.binary())], ["object_key", "number", "content"])

    return df.select(F.col(key).cast("string").alias("object_key"), text, F.col(number).cast("long").alias("number")).mapInArrow(run, "object_key string, number long, content binary")


def unbundled(objects: DataFrame, content: str = "output", counted: bool = False) -> DataFrame:
    """object_key, path, text of every leaf of the objects. counted: and the n_matches of its file; null if the walk reported none of its path.

    Files and leaves of one path go by their order, so no path has to be unique.
    """
    ship(objects.sparkSession)
    schema = pa.schema([("object_key", pa.string()), ("path", pa.string()), ("text", pa.string())] + [("n_matches", pa.int64())] * counted)
    known = [F.transform("files", lambda f: f["path"]).alias("paths"), F.transform("files", lambda f: F.size(f["matches"])).alias("counts")] * counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data, *files in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts: dict[str, deque[int]] = {}
                for path, n in zip(*files, strict=True):
                    counts.setdefault(path, deque()).append(n)
                found = [(key, p, encodings.decode(d, encodings.sniff(d[: encodings.SAMPLE]))[0].removeprefix("﻿")) for p, d in leaves(key, data)]
                if counted:
                    found = [(*f, counts[f[1]].popleft() if counts.get(f[1]) else None) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return objects.select("object_key", content, *known).mapInArrow(run, "object_key string, path string, text string" + ", n_matches long" * counted)
