"""Which policy an object has: its sidecar's, else that of the longest key prefix, else the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDECAR = ".terms.json"
#: Prefixes that are compared with every key at once; more are joined by the key's own prefixes.
MOST_LITERAL = 256


def longest_prefix(key: Column, prefixes: dict[str, str], default: str) -> Column:
    """The policy of the longest prefix of the key, as a ladder of conditions from the longest down."""
    out = F.lit(default)
    for p in sorted(prefixes, key=lambda p: (len(p), p)):
        out = F.when(key.startswith(p), prefixes[p]).otherwise(out)
    return out


def by_prefix(objects: DataFrame, prefixes: DataFrame, default: str, key: str = "object_key") -> DataFrame:
    """objects with policy, for a table of prefixes (prefix, policy) of any size: each key is cut to the lengths that prefixes have and joined by equality."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.desc(F.length("prefix"))).collect()]
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(key, 1, n).alias("p")) for n in lengths]) if lengths else F.array()
    if not lengths:
        return objects.withColumn("policy", F.lit(default))
    each = objects.select(key).distinct().select(key, F.explode(F.filter(cuts, lambda c: F.length(c["p"]) == c["n"])).alias("c"))
    best = each.join(prefixes, F.col("c.p") == F.col("prefix")).groupBy(key).agg(F.max_by("policy", F.length("prefix")).alias("policy"))
    return objects.join(best, key, "left").withColumn("policy", F.coalesce("policy", F.lit(default)))


def with_policy(objects: DataFrame, prefixes: dict[str, str], default: str) -> DataFrame:
    """objects with policy: by a ladder of conditions, or by a join where there are many prefixes."""
    if len(prefixes) <= MOST_LITERAL:
        return objects.withColumn("policy", longest_prefix(F.col("object_key"), prefixes, default))
    table = objects.sparkSession.createDataFrame(list(prefixes.items()), "prefix string, policy string")
    return by_prefix(objects, table, default)


def is_sidecar(key: Column) -> Column:
    return key.endswith(SIDECAR)


def with_sidecars(objects: DataFrame, content: str = "content") -> DataFrame:
    """objects without sidecars, each with own_policy: the text of its own sidecar, or null."""
    own = objects.where(is_sidecar(F.col("object_key"))).select(F.expr(f"left(object_key, length(object_key) - {len(SIDECAR)})").alias("_of"), F.col(content).cast("string").alias("own_policy"))
    rows = objects.where(~is_sidecar(F.col("object_key")))
    return rows.join(own, F.col("object_key") == F.col("_of"), "left").drop("_of")


def status_of(keys: DataFrame, jobs: DataFrame, queue: DataFrame, digests: DataFrame, reports: DataFrame) -> DataFrame:
    """object_key, status, source: where each key's state is known from, the most immediate first."""
    named = lambda df, name: df.select(F.col("object_key").alias(f"_{name}"), F.col("status").alias(f"{name}_status"))
    out, order = keys, ("job", "queue", "digest", "report")
    for name, df in zip(order, (jobs, queue, digests, reports), strict=True):
        out = out.join(named(df, name), F.col("object_key") == F.col(f"_{name}"), "left")
    source = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in order], F.lit("none"))
    status = F.coalesce(*[F.col(f"{n}_status") for n in order], F.lit("unknown"))
    return out.select("object_key", status.alias("status"), source.alias("source"))


def output_keys(keys: DataFrame, jobs: DataFrame, digests: DataFrame) -> DataFrame:
    """object_key and output_key: as the job says, else the digest, else the key itself."""
    j = jobs.select(F.col("object_key").alias("_j"), F.col("output_key").alias("_jo"))
    d = digests.select(F.col("object_key").alias("_d"), F.col("output_key").alias("_do"))
    out = keys.join(j, F.col("object_key") == F.col("_j"), "left").join(d, F.col("object_key") == F.col("_d"), "left")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return out.select("object_key", F.coalesce(empty("_jo"), empty("_do"), "object_key").alias("output_key"))
