"""Helpers that several operators share: tables, the shared folder, Arrow streams."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import ship
from palimpsest.sources.objects import store

#: Rows in an Arrow batch at most: texts are long, and a batch is held whole.
BATCH_ROWS = 256

#: Bytes of a text above which its words are found one by one, not as one list.
LONG_TEXT = 4 << 20

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. One of our own only if none is named, and all run on this machine."""
    sc = spark.sparkContext
    if not (path := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path := "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, folder)
    return folder


def removed(folder: str) -> None:
    with contextlib.suppress(OSError):
        frm, at = store(folder)
        frm.delete_dir(at)


def helpers(names: list[str], *wanted: str) -> list[str]:
    """Names of columns for an operator's own use, which clash with none of the input's."""
    taken, mark = {n.lower() for n in names}, "_"
    while any(f"{mark}{w}".lower() in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow by functions of this package, which get batches of `rows` rows at most, whatever the session's setting is."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def word_lists(raw: bytes, overlap: int = 0, most: int = 1 << 18) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length, each list but the first repeating the last `overlap` words of the one before."""
    if len(raw) <= LONG_TEXT:
        yield raw.split()
        return
    words: list[bytes] = []
    for m in WORD.finditer(raw):
        words.append(m[0])
        if len(words) == most:
            yield words
            words = words[len(words) - overlap :]
    yield words
