"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters and of order 5, a model for each language. A character is one of 4096 symbols: letters of
their own, and classes of digits, space and signs. Trusted documents are
dealt by a hash of their id into two halves: n-grams are counted over the whole texts of one, and each
language's threshold is a quantile of the scores that the other gets, so that it is not set by texts which the
model has seen. A document is rejected if its score is above the threshold of its language.

Counts are summed by (language, n-gram); those of lower orders are continuation counts of the order above;
discounts come from the counts of counts; and each order's probabilities join those of the order below on the
n-gram's suffix. The finished model is dealt into shards by ranges of (language, order, context), of about `shard_rows`
rows each. Executors write each as a file of the shared folder, and map them, one behind the other, into memory to score
texts where they lie: neither the driver nor a broadcast holds any of the model, and pages of a mapped file are given back
when memory is short.

A score is a document's mean negative log-probability per character, with `prior` characters of the
language's mean added, so that a few characters decide nothing.

Defined results: a null language is a language; a null or empty text scores its language's mean and is
kept; a language without trusted documents in both halves has no threshold, and its documents are kept (perplexity
is null without a model); rows that repeat stay repeated, and count as often as they stand; an empty table gives no
rows; labels without a document are ignored; labels that repeat count once, and a document is trusted
only if no label of its own speaks against it; other columns may have any name.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark import TaskContext

from palimpsest.llm.common import by_batch, cut, helpers, own_folder, text_or_empty
from palimpsest.sources.objects import replaced, store

ORDER, QUANTILE, PRIOR = 5, 0.99, 50
#: Rows of the model in one file, 24 bytes each.
SHARD_ROWS = 1 << 16
BITS, CLASSES = 12, 4096
#: Code points of a text that are counted or scored at once.
PART = 1 << 20


def letter(points):
    """The symbol of a letter beyond ASCII, by a hash: two of one language seldom share one."""
    return 64 + (points * 2654435761 >> 9) % (CLASSES - 64)


def classes() -> np.ndarray:
    """The symbol of each code point below 2^16; 0 stands before a text's start."""
    out = np.full(1 << 16, 62, np.uint16)
    for c in range(1 << 16):
        ch = chr(c)
        if c < 32:
            out[c] = 63
        elif c >= 128:
            out[c] = letter(c) if ch.isalpha() else 3 if ch.isdigit() else 1 if ch.isspace() else 62
    for n, chars in ((1, " \t\r"), (2, "\n"), (3, "0123456789"), (58, "."), (59, ","), (60, "?!;:"), (61, "'\"-()")):
        out[[ord(x) for x in chars]] = n
    out[ord("a") : ord("z") + 1] = np.arange(4, 30)
    out[ord("A") : ord("Z") + 1] = np.arange(30, 56)
    return out


TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not TABLE:
        TABLE.append(classes())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = TABLE[0][np.minimum(points, 0xFFFF)]
    if len(far := np.flatnonzero(points > 0xFFFF)):
        out[far] = letter(points[far].astype(np.int64))
    return out


def grams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-gram that ends at each character, packed into an integer, some at a time."""
    before = np.zeros(order - 1, np.int64)
    for at in range(0, len(text), PART):
        all_ = np.concatenate([before, symbols(text[at : at + PART]).astype(np.int64)])
        out = np.zeros(len(all_) - order + 1, np.int64)
        for j in range(order):
            out <<= BITS
            out |= all_[j : len(all_) - order + 1 + j]
        before = all_[len(all_) - order + 1 :]
        yield out


def mask(n: int) -> int:
    return (1 << BITS * n) - 1


def counts(docs: DataFrame, order: int = ORDER, most: int = 1 << 21) -> DataFrame:
    """lang, key, c: how often each n-gram stands in docs (lang, text). Tasks sum theirs first, and pass on what they have whenever they hold `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def summed(flush: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for lang, parts in held.items():
                k, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)
                if flush or len(k) > most // 4:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], ["lang", "key", "c"])
                    held[lang] = []
                else:
                    held[lang] = [np.stack([k, c])]
                    size += len(k)

        for b in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).extend(grams(text, order))
            for lang, parts in texts.items():
                if parts:
                    k, c = np.unique(np.concatenate(parts), return_counts=True)
                    held.setdefault(lang, []).append(np.stack([k, c]))
                    size += len(k)
            if size > most:
                yield from summed(False)
        held = {k: v for k, v in held.items() if v}
        yield from summed(True)

    return by_batch(docs.select("lang", "text"), run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what a count of 1, of 2, and of 3 or more loses, by the counts of counts."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)) for i in (1, 2, 3)]
    return n.select("lang", *[F.greatest(F.least(d[i - 1], F.lit(i - 0.05)), F.lit(0.05)).alias(f"d{i}") for i in (1, 2, 3)])


def estimate(top: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, n, key, p, gamma: of every n-gram of every order its interpolated probability, and the weight that its context gives to the order below. top: lang, key, c of the highest order."""
    levels = {order: cut(top)}
    for n in range(order - 1, 0, -1):  # how many different symbols stand before
        levels[n] = cut(levels[n + 1].groupBy("lang", F.col("key").bitwiseAND(mask(n)).alias("key")).agg(F.count("*").alias("c")))
    below, out = None, []
    for n in range(1, order + 1):
        of_context = Window.partitionBy("lang", "_context")
        x = levels[n].join(F.broadcast(discounts(levels[n])), "lang")  # a row a language
        x = x.withColumn("_context", F.shiftright("key", BITS)).withColumn("_d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        x = x.withColumns({"_total": F.sum("c").over(of_context), "_lost": F.sum("_d").over(of_context)})
        x = x.select("lang", "key", ((F.col("c") - F.col("_d")) / F.col("_total")).alias("_own"), (F.col("_lost") / F.col("_total")).alias("gamma"))
        if below is None:
            x = x.withColumn("_lower", F.lit(1 / CLASSES))
        else:
            lower = below.select("lang", F.col("key").alias("_suffix"), F.col("p").alias("_lower"))
            x = x.withColumn("_suffix", F.col("key").bitwiseAND(mask(n - 1))).join(lower, ["lang", "_suffix"])
        below = cut(x.select("lang", F.lit(n).alias("n"), "key", (F.col("_own") + F.col("gamma") * F.col("_lower")).alias("p"), "gamma"))
        out.append(below)
    model = out[0]
    for x in out[1:]:
        model = model.union(x)
    return model


class Model(NamedTuple):
    """The folder of the shards' files, their numbers in order, and the order of the model."""

    folder: str
    numbers: tuple[int, ...]
    order: int = ORDER


#: Of a language: for each order the sorted n-grams, the sorted contexts, the probabilities, the contexts' weights.
Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
KINDS = ("<i8", "<i8", "<f4", "<f4")


def saved(model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> Model:
    """Writes the model's shards, each by one task, which holds no more than that."""
    folder = own_folder(model.sparkSession, "model")
    shards = max(1, -(-model.count() // shard_rows))
    dealt = model.repartitionByRange(shards, "lang", "n", F.shiftright("key", BITS)).sortWithinPartitions("lang", "n", "key").select("lang", "n", "key", "p", "gamma")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            write_shard(folder, TaskContext.get().partitionId(), pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32())], ["shard"])

    return Model(folder, tuple(sorted(r[0] for r in by_batch(dealt, run, "shard int", rows=65_536).collect())), order)


def write_shard(folder: str, number: int, table: pa.Table) -> None:
    """One file: of each language and order its arrays one behind the other, and at the end a list of where they begin."""
    lang, n = table.column("lang").to_numpy(), table.column("n").to_numpy()
    to, at = store(folder)
    to.create_dir(at, recursive=True)
    own, offset, index = f"{at}/_attempt-{number}-{TaskContext.get().taskAttemptId()}", 0, []
    starts = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (n[1:] != n[:-1])))
    with to.open_output_stream(own) as out:
        for a, b in zip(starts, [*starts[1:], len(n)], strict=True):
            part = table.slice(a, b - a)
            keys, p, gamma = (part.column(c).to_numpy() for c in ("key", "p", "gamma"))
            contexts, first = np.unique(keys >> BITS, return_index=True)
            index.append((lang[a], int(n[a]), offset, len(keys), len(contexts)))
            for x, kind in zip((keys, contexts, p, gamma[first]), KINDS, strict=True):
                out.write(raw := x.astype(kind).tobytes())
                offset += len(raw)
        tail = json.dumps(index).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    replaced(to, own, f"{at}/shard-{number}")


@lru_cache(maxsize=1)
def levels_of(model: Model) -> dict[str, Levels]:
    """Of each language its levels, mapped from a file of this process that has no name any more; once a process."""
    frm, at = store(model.folder)
    parts: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
    for number in model.numbers:
        with frm.open_input_file(f"{at}/shard-{number}") as f:
            size = int.from_bytes(f.read_at(8, f.size() - 8), "little")
            for lang, n, offset, keys, contexts in json.loads(f.read_at(size, f.size() - 8 - size)):
                parts.setdefault((lang, n), []).append((number, offset, keys, contexts))
    handle, name = tempfile.mkstemp(prefix="palimpsest-")
    ends: dict[tuple[str, int], list[int]] = {}
    try:
        with os.fdopen(handle, "wb") as out:
            for key, found in parts.items():
                ends[key] = [out.tell()]
                for i in range(4):
                    for number, offset, keys, contexts in found:
                        sizes = [8 * keys, 8 * contexts, 4 * keys, 4 * contexts]
                        with frm.open_input_file(f"{at}/shard-{number}") as f:
                            out.write(f.read_at(sizes[i], offset + sum(sizes[:i])))
                    ends[key].append(out.tell())
                out.write(bytes(-out.tell() % 8))
        raw = np.memmap(name, np.uint8, "r") if parts else np.empty(0, np.uint8)
    finally:
        os.unlink(name)
    none = tuple(np.empty(0, kind) for kind in KINDS)
    arrays = {key: tuple(raw[a:b].view(kind) for a, b, kind in zip(e, e[1:], KINDS, strict=False)) for key, e in ends.items()}
    return {lang: [arrays.get((lang, n), none) for n in range(1, model.order + 1)] for lang, _ in parts}


def log_probability(levels: Levels, keys: np.ndarray) -> float:
    """The sum of the n-grams' log-probabilities: of those not found, the context's weight times what the order below gives."""
    total = np.zeros(len(keys))
    left = np.arange(len(keys))
    for n in range(len(levels), 0, -1):
        known, contexts, p, gamma = levels[n - 1]
        own = keys[left] & mask(n)
        if len(known):
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[i] == own
            total[left[hit]] += np.log(p[i[hit]])
            left, own = left[~hit], own[~hit]
            if len(left):
                context = own >> BITS
                j = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                seen = contexts[j] == context
                total[left[seen]] += np.log(gamma[j[seen]])
        if not len(left):
            break
    total[left] -= np.log(CLASSES)
    return float(total.sum())


def score(levels: Levels | None, text: str) -> float:
    """The log-probability of a text's characters; 0 without a model."""
    return 0.0 if levels is None else sum((log_probability(levels, keys) for keys in grams(text, len(levels))), 0.0)


def language() -> object:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id: of good quality and not toxic by every label."""
    return labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("ok")).where("ok").select("doc_id")


def half(n: int) -> object:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> Model:
    """The model of the first half of the trusted documents."""
    texts = docs.where(half(0)).select("doc_id", language(), text_or_empty()).join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi")
    return saved(estimate(counts(texts, order), order), order, shard_rows)


def scored(docs: DataFrame, model: Model, chars: str = "chars", logp: str = "logp") -> DataFrame:
    """docs with two columns more: how many characters a text has, and their log-probability (null without a model)."""
    names = docs.columns
    at = names.index("lang"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_of(model)
        for b in batches:
            langs, texts = (b.column(i).to_pylist() for i in at)
            sums = [None if (own := levels.get(lang or "")) is None else score(own, text or "") for lang, text in zip(langs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(t or "") for t in texts], pa.int64()), pa.array(sums, pa.float64())], [*names, chars, logp])

    return by_batch(docs, run, docs.withColumns({chars: F.lit(0).cast("long"), logp: F.lit(None).cast("double")}).schema)


class Thresholds(NamedTuple):
    """Of each language: the mean negative log-probability of a character of trusted text, and the score above which a document is rejected."""

    rows: list[tuple[str, float, float]]

    def frame(self, spark: SparkSession, *names: str) -> DataFrame:
        lang, mean, threshold = names
        return spark.createDataFrame(self.rows, f"{lang} string, {mean} double, {threshold} double")


def thresholds(rows: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR) -> Thresholds:
    """By the scores of the second half of the trusted documents. rows: doc_id, lang, chars, logp, of all documents or of these."""
    held = rows.where(half(1)).join(trusted_ids(labels), "doc_id", "left_semi")
    seen = cut(held.where("logp is not null").select(language(), "chars", "logp"))
    means = seen.groupBy("lang").agg((-F.sum("logp") / F.greatest(F.sum("chars"), F.lit(1))).alias("mean")).collect()  # a row a language
    each = seen.join(F.broadcast(rows.sparkSession.createDataFrame(means, "lang string, mean double")), "lang").withColumn("score", own_score(prior, "chars", "logp", "mean"))
    found = each.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx("score", quantile, 10_000).alias("threshold")).orderBy("lang").collect()
    return Thresholds([tuple(r) for r in found])


def own_score(prior: int, chars: str, logp: str, mean: str) -> object:
    return (-F.col(logp) + prior * F.col(mean)) / (F.col(chars) + prior)


def classified(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, prior: int = PRIOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, chars, perplexity, score, threshold, keep of every row of docs."""
    model = train(docs, labels, order, shard_rows)
    rows = cut(scored(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty()), model).select("doc_id", "lang", "chars", "logp"))
    limits = thresholds(rows, labels, quantile, prior).frame(docs.sparkSession, "own", "mean", "threshold")
    both = rows.join(F.broadcast(limits), F.coalesce("lang", F.lit("")) == F.col("own"), "left").withColumn("score", own_score(prior, "chars", "logp", "mean"))
    perplexity = F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars"))).alias("perplexity")
    return both.select("doc_id", "lang", "chars", perplexity, "score", "threshold", (F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) | (F.col("chars") == 0)).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, prior: int = PRIOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs. Texts are scored where they lie and not moved."""
    model = train(docs, labels, order, shard_rows)
    texts = docs.where(half(1)).select("doc_id", language(), text_or_empty()).join(trusted_ids(labels), "doc_id", "left_semi")
    limits = thresholds(scored(texts, model), labels, quantile, prior)
    chars, logp, own, mean, threshold = helpers(docs.columns, "chars", "logp", "own", "mean", "threshold")
    limits = F.broadcast(limits.frame(docs.sparkSession, own, mean, threshold))
    both = scored(docs, model, chars, logp).join(limits, F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col(own), "left")
    keep = F.coalesce(own_score(prior, chars, logp, mean) <= F.col(threshold), F.lit(True)) | (F.col(chars) == 0)
    return both.where(keep).select(docs.columns)
