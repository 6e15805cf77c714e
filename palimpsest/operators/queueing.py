"""The queue as relations: what is eligible, in which order, who waits where, what is tried again, and the metrics.

A table's whole order is a sort; a rank over all of it is counted in range partitions, so that no task holds
the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.resolve import SIDECAR

# Bounds of the lists, back-off, and the histograms' bounds.
QUEUE_MOST, SNAPSHOT, HISTORY_MOST, JOBS_MOST = 10_000, 50, 100, 200
BACKOFF_DOUBLINGS, BACKOFF_SECONDS = 6, 60
PROCESS_BOUNDS = [0.01 * 3**k for k in range(8)]
WAIT_BOUNDS = [float(2**k) for k in range(10)]


def eligible(objects: DataFrame, cancelled: DataFrame | None = None, deferred: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Objects that may be taken: no sidecar, not among those that are done or cancelled, and not waiting for another try."""
    key = F.col("object_key")
    out = objects.where(~key.endswith(SIDECAR) & ~key.startswith("processed/") & ~key.startswith("cancelled/"))
    if cancelled is not None:
        out = out.join(cancelled.select("object_key"), "object_key", "left_anti")
    if deferred is not None:
        waiting = deferred.where(F.col("defer_until") > (now if now is not None else F.current_timestamp()))
        out = out.join(waiting.select("object_key"), "object_key", "left_anti")
    return out


def due(objects: DataFrame, attempts: DataFrame) -> DataFrame:
    """objects with at: when they arrived or, after a failed try, when their back-off ends."""
    out = objects.join(attempts.select("object_key", "attempts", "defer_until"), "object_key", "left")
    now = F.current_timestamp().cast(objects.schema["last_modified"].dataType)
    return out.withColumn("at", F.when(F.coalesce("attempts", F.lit(0)) > 0, F.coalesce("defer_until", now)).otherwise(F.col("last_modified"))).drop("attempts", "defer_until")


def without_inflight(queue: DataFrame, inflight: DataFrame) -> DataFrame:
    return queue.join(inflight.select("object_key"), "object_key", "left_anti")


def still_there(state: DataFrame, objects: DataFrame) -> DataFrame:
    """State of objects that are still listed; that of others is dropped."""
    return state.join(objects.select("object_key"), "object_key", "left_semi")


def synced(queue: DataFrame, most: int = QUEUE_MOST) -> tuple[DataFrame, DataFrame]:
    """The first `most` by arrival and key, and a row with how many were dropped."""
    kept = queue.orderBy("at", "object_key").limit(most)
    dropped = queue.agg(F.greatest(F.count("*") - most, F.lit(0)).cast("long").alias("dropped"))
    return kept, dropped


def ranked(queue: DataFrame, at: str = "at", key: str = "object_key", buckets: int = 64) -> DataFrame:
    """queue with place, from 1, by (at, key): buckets of arrival times are ranked each, and the sizes of those before added."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = queue.agg(F.min(micros), F.max(micros)).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    placed = queue.withColumn("_bucket", F.floor((micros - F.lit(low or 0)) / F.lit(width)))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_bucket", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(at, key))
    return placed.withColumn("_own", own).join(sizes, "_bucket").withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_before")


def positions(pending: DataFrame, inflight: DataFrame) -> DataFrame:
    """object_key, position, depth: those in flight are at 1, the others behind them; the depth counts both."""
    n_in, n_all = inflight.count(), pending.count()
    running = inflight.select("object_key", F.lit(1).cast("long").alias("position"))
    waiting = ranked(pending).select("object_key", (F.col("place") + n_in).alias("position"))
    return running.union(waiting).withColumn("depth", F.lit(n_in + n_all).cast("long"))


def snapshot(pending: DataFrame, limit: int = SNAPSHOT, inflight: DataFrame | None = None) -> DataFrame:
    """The first `limit` that wait, with running: those in flight, which no limit cuts, come before them."""
    waiting = pending.orderBy("at", "object_key").limit(limit).withColumn("running", F.lit(False))
    if inflight is None:
        return waiting
    both = inflight.withColumn("running", F.lit(True)).unionByName(waiting, allowMissingColumns=True)
    return both.orderBy(F.desc("running"), F.when(~F.col("running"), F.col("at")), "object_key")


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(BACKOFF_DOUBLINGS))), F.lit(float(BACKOFF_SECONDS))).cast("long")


def since(at: Column, now: Column) -> Column:
    """Seconds from then to now, never below zero."""
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(at.cast("timestamp")), F.lit(0))


def history(reports: DataFrame, limit: int = SNAPSHOT, most: int = HISTORY_MOST) -> DataFrame:
    """The newest reports."""
    return reports.orderBy(F.desc("last_modified"), "object_key").limit(min(limit, most))


def latest_jobs(jobs: DataFrame, most: int = JOBS_MOST) -> DataFrame:
    """The last state of each key, the newest keys first."""
    last = F.row_number().over(Window.partitionBy("object_key").orderBy(F.desc("timestamp"), F.desc("seq")))
    return jobs.withColumn("_last", last).where("_last = 1").drop("_last").orderBy(F.desc("timestamp"), F.desc("seq")).limit(most)


def seeded_counts(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """A count for every label, zero where there is none."""
    seed = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    return seed.join(counts, column, "left").select(column, F.coalesce("_n", F.lit(0)).alias("n"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le and how many values are at most that, cumulative, the last one all. One pass: a value meets the bounds as columns."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.agg(*counts, F.count(value).alias("total"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return wide.select(F.explode(pairs).alias("p")).select("p.le", "p.n")


def upload_key(name: Column, token: Column) -> Column:
    """A safe key for an uploaded file: eight hex digits and its base name."""
    base = F.regexp_replace(F.substring_index(F.substring_index(name, "/", -1), "\\", -1), "[^A-Za-z0-9._-]", "_")
    return F.concat(token, F.lit("-"), F.coalesce(F.nullif(base, F.lit("")), F.lit("upload")))
