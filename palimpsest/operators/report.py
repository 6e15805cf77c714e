"""What is reported of a run: files, capped detail, exact counts, the verdict, the digest and the banner.

All of it is aggregation over the rows of files; counts never depend on the caps of the detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.columns import redacted
from palimpsest.operators.walk import INSPECTED

# How much detail a report holds.
FILE_MATCHES, REPORT_MATCHES, NOTES, SAMPLES = 1000, 20_000, 100, 20
AUDITS = ("full", "counts", "off")


def is_inspected(status: Column) -> Column:
    return status.isin(*INSPECTED)


def disposition(status: Column) -> Column:
    """Anything that is not known to be inspected is not."""
    return F.when(is_inspected(status), "inspected").otherwise("not-inspected")


def verdict(not_inspected: Column, residual_hits: Column) -> Column:
    return F.when(not_inspected == 0, "complete").when(residual_hits > 0, "incomplete-risky").otherwise("incomplete")


def needs_review(verdict_: Column) -> Column:
    return verdict_ == "incomplete-risky"


def output_key(key: Column, verdict_: Column) -> Column:
    return F.when(needs_review(verdict_), F.concat(F.lit("review/"), key)).otherwise(key)


#: Numbers of files in a row whose budgets one task adds up.
BLOCK_FILES = 4096


def capped(files: DataFrame, per_file: int = FILE_MATCHES, per_report: int = REPORT_MATCHES, audit: str = "full", count: str = "match_count", block: int = BLOCK_FILES) -> DataFrame:
    """files with kept (how many matches of each are listed) and matches_truncated; budgets run in file order: within blocks of numbers, with what the blocks before have used."""
    least = F.least(F.col(count), F.lit(per_file))
    if files.schema["seq"].dataType.typeName() == "struct":  # objects of a run, and the files of each
        number = F.struct(F.col("seq.object"), F.floor(F.col("seq.seq") / block).alias("n"))
    else:
        number = F.struct(F.floor(F.col("seq") / block).alias("n"))
    rows = files.withColumns({"_block": number, "_least": least})
    used = rows.groupBy("object_key", "_block").agg(F.sum("_least").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("object_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = used.select(F.col("object_key").alias("_key"), F.col("_block").alias("_of"), before.alias("_before"))
    rows = rows.join(used, F.col("object_key").eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    own = F.coalesce(F.sum("_least").over(Window.partitionBy("object_key", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.lit(0).cast("long") if audit == "off" else F.greatest(F.least(F.col("_least"), per_report - F.col("_before") - own), F.lit(0)).cast("long")
    out = rows.withColumn("kept", kept).select(*files.columns, "kept")
    return out.withColumn("matches_truncated", F.lit(audit != "off") & (F.col("kept") < F.col(count)))


def audited(matches: Column, kept: Column, audit: str = "full", salt: str | None = None) -> Column:
    """The matches that a report lists: all of each, only where they are, or none; originals as digests if there is a salt."""
    if audit not in AUDITS:
        raise ValueError(f"unknown audit level {audit!r}")
    if audit == "off":
        return F.slice(matches, 1, 0)
    some = F.slice(matches, 1, kept.cast("int"))
    none = F.lit(None).cast("string")
    original = none if audit == "counts" else "original"
    return F.transform(
        some,
        lambda m: F.struct(
            m["rule"].alias("rule"), m["line"].alias("line"), m["offset"].alias("offset"),
            (none if original is none else redacted(m["original"], salt) if salt is not None else m["original"]).alias("original"),
            (none if audit == "counts" else m["replacement"]).alias("replacement"),
        ),
    )


def counters(prefix: str = "") -> list[Column]:
    """Aggregates over files: of statuses, of coverage, and sums."""
    s = F.col("status")
    other = ~s.isin("scrubbed", "unchanged", "binary-skipped")
    return [
        F.count("*").alias("files_total"), F.count_if(s == "scrubbed").alias("files_scrubbed"), F.count_if(s == "unchanged").alias("files_unchanged"),
        F.count_if(s == "binary-skipped").alias("files_binary_skipped"), F.count_if(other).alias("files_passthrough"),
        F.count_if(is_inspected(s)).alias("files_inspected"), F.count_if(~is_inspected(s)).alias("files_not_inspected"),
        F.coalesce(F.sum("match_count"), F.lit(0)).alias("total_matches"), F.coalesce(F.sum("residual_hits"), F.lit(0)).alias("residual_hits"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"),
    ]


def counted(rows: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """A map of counts by key for each group."""
    each = rows.groupBy(*by, key).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_n")))).alias(out))


def summary(files: DataFrame, by: list[str] | None = None, notes: int = NOTES) -> DataFrame:
    """A row for each object: counters, matches by rule and by label, holes by reason, the first notes, and the verdict."""
    by = by or ["object_key"]
    out = files.groupBy(*by).agg(*counters())
    matches = files.select(*by, F.explode("matches").alias("m")).select(*by, "m.rule", F.col("m.replacement").alias("label"))
    holes = files.where(~is_inspected(F.col("status")))
    first = Window.partitionBy(*by).orderBy("seq")
    noted = holes.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= notes)
    note = F.struct("seq", "path", "status", F.col("reason").alias("code"), F.col("detail").alias("reason"), "residual")
    noted = noted.groupBy(*by).agg(F.sort_array(F.collect_list(note)).alias("not_inspected"))
    for x in (counted(matches, by, "rule", "matches_by_rule"), counted(matches, by, "label", "matches_by_label"), counted(holes.withColumn("reason", F.coalesce("reason", F.lit("unclassified"))), by, "reason", "by_reason"), noted):
        out = out.join(x, by, "left")
    empty = F.expr("cast(map() as map<string,bigint>)")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("matches_by_rule", "matches_by_label", "by_reason")})
    return out.withColumn("verdict", verdict(F.col("files_not_inspected"), F.col("residual_hits")))


def samples_of(files: DataFrame) -> DataFrame:
    """object_key, seq, sample of the files that were not inspected and that the policy would have changed."""
    sample = F.concat("path", F.lit(" ("), "reason", F.lit("): "), "residual")
    return files.where((F.col("residual_hits") > 0) & ~is_inspected(F.col("status"))).select("object_key", "seq", sample.alias("sample"))


def with_samples(summaries: DataFrame, samples: DataFrame, most: int = SAMPLES) -> DataFrame:
    """summaries with residual_samples, the first `most` of each object (object_key, seq, sample) in file order; counts don't depend on it."""
    first = F.row_number().over(Window.partitionBy("object_key").orderBy("seq"))
    few = samples.withColumn("_n", first).where(F.col("_n") <= most).groupBy("object_key").agg(F.sort_array(F.collect_list(F.struct("seq", "sample"))).alias("_few"))
    kept = F.coalesce(F.transform("_few", lambda x: x["sample"]), F.array().cast("array<string>"))
    return summaries.join(few, "object_key", "left").withColumn("residual_samples", kept).drop("_few")


def digest(summaries: DataFrame) -> DataFrame:
    """The narrow part of a summary, as columns and as one line of JSON."""
    names = ["object_key", "verdict", "files_total", "files_scrubbed", "files_not_inspected", "files_binary_skipped", "files_passthrough", "total_matches", "residual_hits", "matches_by_label", "by_reason"]
    return summaries.select(*names, F.to_json(F.struct(*names)).alias("digest"))


def report_json(files: DataFrame, summaries: DataFrame, audit: str = "full", salt: str | None = None) -> DataFrame:
    """object_key and its report as JSON: the files with their listed matches, and the summary."""
    listed = capped(files, audit=audit).withColumn("matches", audited(F.col("matches"), F.col("kept"), audit, salt))
    names = ["path", "status", "reason", "detail", "bytes_in", "bytes_out", "match_count", "matches_truncated", "matches"]
    per = listed.groupBy("object_key").agg(F.sort_array(F.collect_list(F.struct("seq", *names))).alias("files"))
    both = per.join(summaries.select("object_key", F.struct(*[c for c in summaries.columns if c != "object_key"]).alias("summary")), "object_key")
    return both.select("object_key", F.to_json(F.struct(F.col("object_key").alias("source"), "files", "summary"), {"pretty": "true"}).alias("report"))


def progress(files: DataFrame) -> DataFrame:
    """What a watcher of the run may see of a file: never its matches."""
    return files.select("path", "status", "detail", "bytes_in", "bytes_out")


def breakdown(counts: DataFrame, rule: str = "rule", n: str = "n") -> DataFrame:
    """Lines of a rule breakdown, the most frequent first, then by rule."""
    place = F.row_number().over(Window.orderBy(F.desc(n), rule))
    return counts.select(place.cast("long").alias("place"), F.format_string("  %6d  %s", F.col(n), F.col(rule)).alias("line"))


def banner(summaries: DataFrame) -> DataFrame:
    """object_key and a verdict line that names the holes."""
    said = F.when(F.col("verdict") == "complete", F.format_string("COMPLETE: all %d file(s) inspected", "files_total")).otherwise(
        F.format_string("%s: %d of %d file(s) NOT inspected (%s)", F.upper("verdict"), "files_not_inspected", "files_total", F.array_join(F.transform(F.map_entries("by_reason"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "))
    )
    return summaries.select("object_key", said.alias("banner"))
