"""Objects of a folder or a bucket: listing, reading within bounds, and writing outputs whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import ship


def root_of(spark: SparkSession, path: str) -> str:
    """The path as Spark writes it in front of each file's own: of a single file, its folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    status = fs.getFileStatus(p)
    at = status.getPath() if status.isDirectory() else status.getPath().getParent()
    return at.toString().rstrip("/") + "/"


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """object_key, path, size, last_modified; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = root_of(spark, path)
    key = F.expr(f"substring(path, {len(root) + 1})")
    return reader.load(path).select(key.alias("object_key"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")


def objects(spark: SparkSession, path: str, most: int | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects with content, and those above `most` bytes, whose contents are never read."""
    rows = listing(spark, path, pattern)
    if most is None:
        return rows, rows.drop("content").where("false")
    return rows.where(F.col("size") <= most), rows.drop("content").where(F.col("size") > most)


def exists(rows: DataFrame, key: str) -> bool:
    return not rows.where(F.col("object_key") == key).isEmpty()


def store(uri: str) -> tuple[afs.FileSystem, str]:
    if re.match("file:", uri):
        return afs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return afs.FileSystem.from_uri(uri) if "://" in uri else (afs.LocalFileSystem(), uri)


def mark_of(key: str) -> str:
    """The name of a key's file in a folder of marks."""
    return hashlib.sha256(key.encode("utf-8", "surrogateescape")).hexdigest() + ".json"


class Marks:
    """What is kept of keys, beyond the life of a driver: a file a key, written whole."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.to, self.at = store(folder)
        self.to.create_dir(self.at, recursive=True)

    def put(self, key: str, value: dict) -> None:
        own = f"{self.at}/.{mark_of(key)}"
        with self.to.open_output_stream(own) as f:
            f.write(json.dumps({"key": key} | value).encode())
        replaced(self.to, own, f"{self.at}/{mark_of(key)}")

    def drop(self, key: str) -> None:
        if self.to.get_file_info(f"{self.at}/{mark_of(key)}").type == afs.FileType.File:
            self.to.delete_file(f"{self.at}/{mark_of(key)}")

    def all(self) -> dict[str, dict]:
        out = {}
        for info in self.to.get_file_info(afs.FileSelector(self.at)):
            if info.type == afs.FileType.File and not info.base_name.startswith("."):
                with self.to.open_input_stream(info.path) as f:
                    value = json.loads(f.read())
                out[value.pop("key")] = value
        return out


def contents(rows: DataFrame) -> DataFrame:
    """Listed objects (object_key, path) with content and read_error: a local file that can't be read is a row, not a failed job."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, error = b"", None
                try:
                    with open(re.sub("^file:/*", "/", path), "rb") as f:
                        data = f.read()
                except OSError as e:
                    error = str(e.strerror or e)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key, pa.string()), (data, pa.binary()), (error, pa.string()))], ["object_key", "content", "read_error"])

    return rows.select("object_key", "path").mapInArrow(run, "object_key string, content binary, read_error string")


def replaced(to: afs.FileSystem, own: str, target: str) -> None:
    """Moves a file that is whole to its name, over one that an earlier attempt left there, as not all file systems do by themselves."""
    if not isinstance(to, afs.LocalFileSystem) and to.get_file_info(target).type == afs.FileType.File:
        to.delete_file(target)
    to.move(own, target)


def write_objects(rows: DataFrame, folder: str, key: str = "output_key", content: str = "output", like: str | None = None) -> DataFrame:
    """Writes each row's content under its key, and returns output_key, bytes. A file appears whole, by a rename from a name that is the attempt's own.

    like: a column with the path of a local file, whose mode a local output gets; where there is none, the mode is the system's own.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, at = store(folder)
        context = TaskContext.get()
        mark = f"{context.partitionId()}-{context.taskAttemptId()}"
        for b in batches:
            sizes = []
            for name, data, origin in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                target = f"{at}/{name}"
                own = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{mark}"
                to.create_dir(os.path.dirname(target), recursive=True)
                with to.open_output_stream(own) as f:
                    f.write(data.as_buffer())
                if origin and isinstance(to, afs.LocalFileSystem) and os.path.isfile(origin):
                    os.chmod(own, stat.S_IMODE(os.stat(origin).st_mode))
                replaced(to, own, target)
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["output_key", "bytes"])

    return rows.select(F.col(key).alias("output_key"), F.coalesce(F.col(content), F.lit(b"")).alias("content"), (F.col(like) if like else F.lit(None)).cast("string").alias("origin")).mapInArrow(run, "output_key string, bytes long")


def write_texts(rows: DataFrame, folder: str, key: str, text: str, suffix: str) -> DataFrame:
    """The same for reports and digests: a file a row, named by its key."""
    named = rows.select(F.concat(F.col(key), F.lit(suffix)).alias("output_key"), F.encode(F.col(text), "UTF-8").alias("output"))
    return write_objects(named, folder)


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that earlier runs left: their columns, and when they were written."""
    files = listing(spark, folder, "*.summary.json")
    schema = "object_key string, verdict string, files_total long, files_scrubbed long, files_not_inspected long, files_binary_skipped long, files_passthrough long, total_matches long, residual_hits long, matches_by_label map<string,long>, by_reason map<string,long>"
    return files.select("last_modified", F.from_json(F.col("content").cast("string"), schema).alias("d")).select("d.*", "last_modified")


def full_reports(spark: SparkSession, folder: str) -> DataFrame:
    """object_key and report: the full report, or the digest where there is none."""
    full = listing(spark, folder, "*.report.json").select(F.expr("left(object_key, length(object_key) - 12)").alias("object_key"), F.col("content").cast("string").alias("_full"))
    short = listing(spark, folder, "*.summary.json").select(F.expr("left(object_key, length(object_key) - 13)").alias("_key"), F.col("content").cast("string").alias("_short"))
    both = full.join(short, F.col("object_key") == F.col("_key"), "full")
    return both.select(F.coalesce("object_key", "_key").alias("object_key"), F.coalesce("_full", "_short").alias("report"))
