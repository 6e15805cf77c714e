"""Continuous operation: objects that land in a folder are taken in order of arrival, rewritten, reported, and put away.

The file source's checkpoint is the queue that survives a restart. Each micro-batch re-reads the policies (a
bad set leaves the last good one), resolves each object's policy, walks the objects in parallel, writes outputs, reports and
digests, and only then marks the batch done; all writes are renames of whole files under names that the input decides, so
a batch that runs again leaves the same files. Cancelled keys are left out at the batch's start, abort their walk, and are left out
again before the first write, which is one point under a lock: a key is either cancelled or committed. What fails is tried
again after a back-off, behind all that arrived by then. Cancels and failed tries are files beside the checkpoint, so that a
driver which starts again knows them. An object that is too large is not read: it has a report and is put away.
"""

from __future__ import annotations

import hashlib
import hmac
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import queueing, report, resolve, walk
from palimpsest.plans.policy import PolicyError, Registry
from palimpsest.sources import objects as store

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Service:
    inbox: str
    outbox: str
    reports: str
    checkpoint: str
    registry: Registry
    policies: str | None = None
    limits: walk.Limits = walk.Limits()
    audit: str = "counts"
    salt: str = "palimpsest"
    most_bytes: int | None = None
    archive: str | None = None
    #: Where inputs go when they are done or cancelled, under processed/ and cancelled/; none: they stay.
    done: str | None = None
    #: Inputs that are done are deleted instead.
    delete: bool = False
    cancelled: set[str] = field(default_factory=set)
    #: Of objects that failed: how often, and when the next try is due.
    deferred: dict[str, tuple[int, float]] = field(default_factory=dict)
    running: set[str] = field(default_factory=set)
    committed: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.lock = threading.Lock()
        self.cancels, self.tries = (store.Marks(f"{self.checkpoint.rstrip('/')}-{kind}") for kind in ("cancelled", "tries"))
        for key in self.cancelled:
            self.cancels.put(key, {})
        self.cancelled |= set(self.cancels.all())
        self.deferred |= {key: (v["tries"], v["until"]) for key, v in self.tries.all().items()}

    def defer(self, key: str, now: float) -> None:
        n = self.deferred.get(key, (0, 0.0))[0] + 1
        self.deferred[key] = (n, now + min(2 ** min(n, queueing.BACKOFF_DOUBLINGS), queueing.BACKOFF_SECONDS))
        self.tries.put(key, {"tries": n, "until": self.deferred[key][1]})

    def settle(self, keys: set[str], kind: str) -> None:
        """Puts inputs away; one that is gone already was put away by an earlier attempt."""
        frm, at = store.store(self.inbox)
        for key in sorted(keys):
            if self.deferred.pop(key, None):
                self.tries.drop(key)
            if kind == "processed" and self.delete:
                if frm.get_file_info(f"{at}/{key}").is_file:
                    frm.delete_file(f"{at}/{key}")
            elif self.done and frm.get_file_info(f"{at}/{key}").is_file:
                to, folder = store.store(self.done)
                target = f"{folder}/{kind}/{key}"
                to.create_dir(target.rpartition("/")[0], recursive=True)
                store.replaced(to, f"{at}/{key}", target)

    def source(self, spark: SparkSession, per_trigger: int = 1) -> DataFrame:
        """New objects, the earliest first, a few at a time."""
        reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", str(per_trigger)).option("recursiveFileLookup", "true").option("latestFirst", "false")
        if self.archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", self.archive)
        return reader.load(self.inbox)

    def start(self, spark: SparkSession, per_trigger: int = 1, interval: str | None = "15 seconds") -> StreamingQuery:
        """interval None: all that is there now, and then the end."""
        writer = self.source(spark, per_trigger).writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def reload(self) -> str | None:
        """Reads the policies again; returns why not, if they are no good."""
        if self.policies:
            try:
                self.registry.reload(self.policies)
            except (PolicyError, OSError) as e:
                return str(e)
        return None

    def cancel(self, spark: SparkSession, key: str) -> str:
        """withdrawn: it will not be taken; aborting: its walk goes on, and nothing is written of it; too-late: it is out; not-found."""
        with self.lock:
            if key in self.committed:
                return "too-late"
            found = key in self.running
            if found:
                self.cancels.put(key, {})
                self.cancelled.add(key)
                return "aborting"
        if not store.exists(store.listing(spark, self.inbox), key):
            return "not-found"
        with self.lock:
            self.cancels.put(key, {})
            self.cancelled.add(key)
        self.settle({key}, "cancelled")
        return "withdrawn"

    def token(self, key: str, secret: bytes) -> str:
        """What allows the cancelling of a key."""
        return hmac.new(secret, key.encode(), hashlib.sha256).hexdigest()[:32]

    def batch(self, rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        self.reload()
        root = store.root_of(spark, self.inbox)
        all_ = rows.select(F.expr(f"substring(path, {len(root) + 1})").alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")
        cancelled = spark.createDataFrame([(k,) for k in sorted(self.cancelled)], "object_key string")
        fresh = queueing.eligible(all_, cancelled=cancelled)
        large = fresh.where(F.col("size") > self.most_bytes) if self.most_bytes is not None else fresh.where("false")
        if self.most_bytes is not None:
            fresh = fresh.where(F.col("size") <= self.most_bytes)
        self.take(fresh.select("object_key", "content"), large.select("object_key", "size"))
        self.again(spark)

    def take(self, rows: DataFrame, large: DataFrame | None = None) -> None:
        """large: objects that are too large (object_key, size), whose contents are not read."""
        rows = rows.withColumn("own_policy", F.lit(None).cast("string")).where(~resolve.is_sidecar(F.col("object_key")))
        frm, at = store.store(self.inbox)
        own = []
        for (key,) in rows.select("object_key").collect():  # a micro-batch has maxFilesPerTrigger of them
            path = f"{at}/{key}{resolve.SIDECAR}"
            if frm.get_file_info(path).is_file:
                with frm.open_input_stream(path) as f:
                    own.append((key, f.read().decode("utf-8", "replace")))
        if own:
            sidecars = rows.sparkSession.createDataFrame(own, "_of string, _own string")
            rows = rows.join(sidecars, F.col("object_key") == F.col("_of"), "left").withColumn("own_policy", F.col("_own")).drop("_of", "_own")
        process(rows, self, large)

    def again(self, spark: SparkSession, now: float | None = None) -> int:
        """Another try of what failed and is due, behind all that has arrived; how many."""
        moment = time.time() if now is None else now
        due = sorted(k for k, (_, until) in self.deferred.items() if until <= moment and k not in self.cancelled)
        if due:
            self.take(store.listing(spark, self.inbox).where(F.col("object_key").isin(due)).select("object_key", "content"))
        return len(due)


def too_large(large: DataFrame, most: int | None) -> DataFrame:
    """Objects that were not read, as files of reports."""
    empty = F.array().cast(f"array<{walk.MATCH}>")
    return large.select(
        "object_key", F.lit(0).alias("seq"), F.col("object_key").alias("path"), F.lit("guard-tripped").alias("status"), F.lit("expansion-budget").alias("reason"), F.lit(f"larger than {most} bytes; not read").alias("detail"),
        F.col("size").cast("long").alias("bytes_in"), F.lit(0).cast("long").alias("bytes_out"), empty.alias("matches"), F.lit(0).cast("long").alias("residual_hits"), F.lit("").alias("residual"), F.lit(0).cast("long").alias("match_count"),
    )


def process(rows: DataFrame, service: Service, large: DataFrame | None = None) -> DataFrame:
    """Walks objects (object_key, content, own_policy) and writes outputs, digests and reports; returns the digests.

    What has been cancelled until the first write goes out in no form. Objects that failed are left for another try.
    """
    registry, spark = service.registry, rows.sparkSession
    rows = resolve.with_policy(rows, registry.prefixes, registry.default)
    with service.lock:
        service.running = {r[0] for r in rows.select("object_key").collect()}  # a micro-batch has maxFilesPerTrigger of them
    done = walk.walked(rows, registry.policies, registry.default, service.limits, F.col("policy"), F.col("own_policy"), service.cancels.folder).persist()
    try:
        failed = {r[0] for r in done.where(F.col("error") != walk.ABORTED).select("object_key").collect()}
        aborted = {r[0] for r in done.where(F.col("error") == walk.ABORTED).select("object_key").collect()}
        with service.lock:
            stopped = (service.cancelled | aborted) & service.running
            ready = service.running - stopped - failed
            service.committed |= ready
        off = spark.createDataFrame([(k,) for k in sorted(stopped | failed)], "object_key string")
        good = done.join(off, "object_key", "left_anti")
        files = walk.files(good)
        if large is not None:
            files = files.unionByName(too_large(large, service.most_bytes))
        summaries = report.with_samples(report.summary(files), walk.samples(good)).persist()
        routed = good.join(summaries.select("object_key", "verdict"), "object_key").withColumn("output_key", report.output_key(F.col("object_key"), F.col("verdict")))
        store.write_objects(routed, service.outbox).count()
        digests = report.digest(summaries)
        store.write_texts(report.report_json(files, summaries, service.audit, service.salt), service.reports, "object_key", "report", ".report.json").count()
        store.write_texts(digests, service.reports, "object_key", "digest", ".summary.json").count()
        service.settle(ready | ({r[0] for r in large.select("object_key").collect()} if large is not None else set()), "processed")
        service.settle(stopped, "cancelled")
        for key in failed - stopped:
            service.defer(key, time.time())
        return digests
    finally:
        with service.lock:
            service.running = set()
        done.unpersist()


def throughput(jobs: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Finished jobs (timestamp, verdict, bytes_in) by window and verdict; in a stream, what comes later than `late` is left out."""
    return jobs.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "verdict").agg(F.count("*").alias("jobs"), F.sum("bytes_in").alias("bytes_in"))
