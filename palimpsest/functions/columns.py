"""A policy as Column expressions, for text that lies in tables: all on the JVM, one alternation for all rules.

Rows without any of the characters and strings that matches need skip the alternation. Rules that can match an empty
string go through Python, since the JVM's split treats empty matches in a way of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import validators
from palimpsest.functions.matching import Matcher
from palimpsest.plans import regex
from palimpsest.plans.policy import Policy
from palimpsest.runtime import ship


def combined(policy: Policy) -> str:
    return "|".join(f"(?:{regex.for_java(r.pattern)})" for r in policy.rules)


#: Set around each match, so that one pass of the alternation gives the spans and what lies between; a noncharacter.
MARK = "\uffff"


def parts_of(text: Column, policy: Policy) -> Column:
    """A text cut at its candidate spans: what lies before the first, the first, what lies between, and so on."""
    need, pattern = policy.needed(), combined(policy)
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # a text with the mark itself pays for the alternation twice
    spans, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    plain = F.concat(F.slice(gaps, 1, 1), F.flatten(F.zip_with(spans, F.slice(gaps, 2, F.greatest(F.size(spans), F.lit(0))), lambda s, g: F.array(s, g))))
    out = F.when(text.contains(MARK), plain)
    if need is None:
        return out.otherwise(parts)
    return F.when(text.isNull(), F.lit(None)).when(~text.rlike(need.pattern(True)), F.array(text)).otherwise(out.otherwise(parts))


def spans_of(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def gaps_of(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 0)


def rule_of(span: Column, policy: Policy) -> Column:
    """The index of the first rule that takes the span alone as a whole, else of the first that matches in it."""
    whole, some = F.lit(None).cast("int"), F.lit(None).cast("int")
    java = [regex.for_java(r.pattern) for r in policy.rules]
    for i, p in reversed(list(enumerate(java))):
        whole = F.when(F.regexp_extract(span, f"({p})", 1) == span, i).otherwise(whole)
        some = F.when(span.rlike(p), i).otherwise(some)
    return F.lit(0) if len(java) == 1 else F.coalesce(whole, some)


def valid(span: Column, rule: Column, policy: Policy) -> Column:
    out = F.lit(True)
    for i, r in enumerate(policy.rules):
        if r.validator:
            out = out & ((rule != i) | validators.COLUMN[r.validator](span))
    return F.coalesce(out & rule.isNotNull(), F.lit(False))


def picked(rule: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rule + 1)


def inspected(df: DataFrame, text: str, policy: Policy) -> DataFrame:
    """df with _spans (struct of span, rule, ok) and _gaps."""
    df = df.withColumn("_parts", parts_of(F.col(text), policy))
    df = df.withColumns({"_named": F.transform(spans_of(F.col("_parts")), lambda s: F.struct(s.alias("span"), rule_of(s, policy).alias("rule"))), "_gaps": gaps_of(F.col("_parts"))})
    return df.withColumn("_spans", F.transform("_named", lambda c: F.struct(c["span"].alias("span"), c["rule"].alias("rule"), valid(c["span"], c["rule"], policy).alias("ok")))).drop("_parts", "_named")


def scrubbed(df: DataFrame, text: str, policy: Policy, out: str = "clean_text", count: str = "n_matches") -> DataFrame:
    """df with the rewritten text and the count of its matches; null text stays null, with no matches."""
    if policy.may_match_empty:
        return scrubbed_by_python(df, text, policy, out, count)
    df = inspected(df, text, policy)
    labels = [policy.replacement(r) for r in policy.rules]
    pieces = F.zip_with("_spans", F.slice("_gaps", 2, F.greatest(F.size("_gaps") - 1, F.lit(0))), lambda c, g: F.concat(F.when(c["ok"], picked(c["rule"], labels)).otherwise(c["span"]), g))
    fresh = F.when(F.size("_spans") == 0, F.col(text)).otherwise(F.concat(F.element_at("_gaps", 1), F.array_join(pieces, "")))
    n = F.coalesce(F.size(F.filter("_spans", lambda c: c["ok"])), F.lit(0))
    return df.withColumns({out: fresh, count: F.greatest(n, F.lit(0)).cast("long")}).drop("_spans", "_gaps")


def scrubbed_by_python(df: DataFrame, text: str, policy: Policy, out: str, count: str) -> DataFrame:
    ship(df.sparkSession)
    at, names = df.columns.index(text), [*df.columns, out, count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(policy)
        for b in batches:
            got = [(None, []) if t is None else matcher.scrub(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64())], names)

    schema = df.withColumns({out: F.lit(None).cast("string"), count: F.lit(0).cast("long")}).schema
    return df.mapInArrow(run, schema)


#: Elements of an array that are summed up one after the other; longer arrays are summed in blocks.
BLOCK = 256


def sums_before(values: Column, block: int = BLOCK) -> Column:
    """For each number of an array the sum of those before it."""
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / block), F.lit(0)).cast("int")), lambda k: F.slice(values, k * block + 1, block))
    starts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda x, y: x + y)), F.array(F.lit(0).cast("long")), add)
    return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(F.aggregate(b, F.array(s), add), 1, F.size(b))))


def match_records(df: DataFrame, key: list[str], text: str, policy: Policy) -> DataFrame:
    """key, ordinal, rule, line, offset (in bytes of UTF-8), original, replacement: a row a match, in document order within a row of df.

    All is counted within the row, so rows that share a key, or have none, don't meet, and nothing is shuffled.
    """
    ids, labels = [r.id for r in policy.rules], [policy.replacement(r) for r in policy.rules]
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = inspected(df.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.col(text).alias("_text")), "_text", policy)
    measured = F.zip_with(
        "_spans", F.slice("_gaps", 1, F.size("_spans")),
        lambda s, g: F.struct(s.alias("s"), F.octet_length(g).cast("long").alias("g_bytes"), F.octet_length(s["span"]).cast("long").alias("s_bytes"), newlines(g).cast("long").alias("g_lines"), newlines(s["span"]).cast("long").alias("s_lines")),
    )
    rows = rows.select(*[f"_key_{k}" for k in key], measured.alias("_m"))
    rows = rows.withColumns({"_bytes": F.transform("_m", lambda m: m["g_bytes"] + m["s_bytes"]), "_lines": F.transform("_m", lambda m: m["g_lines"] + m["s_lines"])})
    rows = rows.withColumns({"_bytes": sums_before(F.col("_bytes")), "_lines": sums_before(F.col("_lines"))})
    hits = F.filter(F.arrays_zip("_m", "_bytes", "_lines"), lambda z: z["_m"]["s"]["ok"])
    # an outer explode: Spark would push the test of an inner one, and with it the alternation, below a repartition
    each = rows.select(*[f"_key_{k}" for k in key], F.posexplode_outer(hits).alias("_at", "_z")).where(F.col("_z").isNotNull())
    rule, own = F.col("_z._m.s.rule"), F.col("_z._m")
    return each.select(
        *[F.col(f"_key_{k}").alias(k) for k in key], (F.col("_at") + 1).cast("long").alias("ordinal"), picked(rule, ids).alias("rule"), (1 + F.col("_z._lines") + own["g_lines"]).alias("line"),
        (F.col("_z._bytes") + own["g_bytes"]).alias("offset"), own["s"]["span"].alias("original"), picked(rule, labels).alias("replacement"),
    )


def scrubbed_names(df: DataFrame, name: str, policy: Policy, out: str = "clean_name") -> DataFrame:
    """df with the path whose segments are rewritten one by one; a separator that a replacement brings becomes `_`."""
    rows = df.withColumn("_parts", F.split(name, "/"))
    labels = [policy.replacement(r) for r in policy.rules]

    def fresh(part: Column) -> Column:
        parts = parts_of(part, policy)
        spans, gaps = spans_of(parts), gaps_of(parts)
        named = F.transform(spans, lambda s: F.struct(s.alias("span"), rule_of(s, policy).alias("rule")))
        checked = F.transform(named, lambda c: F.struct(F.when(valid(c["span"], c["rule"], policy), picked(c["rule"], labels)).alias("label"), c["span"].alias("span")))
        pieces = F.zip_with(checked, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda c, g: F.concat(F.coalesce(c["label"], c["span"]), g))
        changed = F.exists(checked, lambda c: c["label"].isNotNull())
        return F.when(~part.isin("", ".", "..") & changed, F.translate(F.concat(F.element_at(gaps, 1), F.array_join(pieces, "")), "/\\", "__")).otherwise(part)

    return rows.withColumn(out, F.array_join(F.transform("_parts", fresh), "/")).drop("_parts")


def redacted(original: Column, salt: str) -> Column:
    """A match's digest, which shows equal ones as equal and no more."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(salt), original), 256), 1, 12))
