"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources, in code-point order with null last, weigh `weights`, repeating, and share all words; a target stops
at `most` times its source's size, and the excess is shared among the others by weight until none is above.
Blocks of `block` words go to sources by highest quotients target / (2 seats + 1), then a source's blocks go
to its shards (documents dealt by a hash of their id and text, some thousands each) in the same way, by the shards' sizes. A
shard's documents stand in seeded order on a line of words; whole passes take the line once each, and the
blocks that are left are a run of neighbours from a seeded block on, round the line's end. So no block is
ever a row, and a hot source is many shards.

Defined results: null and empty texts have size 0 and nothing is taken of them; a null source is a source;
rows that share a doc_id are dealt by their texts, and rows that repeat stand side by side; reruns agree; an empty table gives no rows. Columns of the
input keep their names, and helper columns start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK, SHARD_ROWS, SEED = (5, 2, 1), 3, 32, 4096, "42"


def text_digest(text: Column = None) -> Column:
    """What tells the texts of one id apart."""
    return F.md5(F.encode(F.coalesce(F.col("text") if text is None else text, F.lit("")), "UTF-8")).alias("_text")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt(digest: Column, first: int) -> Column:
    """A number from 8 of a digest's hex digits."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """parties with a column `out`: the seats of each, of those that its group has, by highest quotients votes / (2 n + 1), ties by key.

    With n parties, V votes and H seats, no party can end outside of its votes times (H -+ n/2) / V, rounded; so only
    quotients within those bounds are ranked, about three a party, and the rest are certain.
    """
    g = Window.partitionBy(*group)
    n, v, h = F.count("*").over(g), F.sum(votes).over(g), F.col(seats)
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0)
    p = parties.withColumns({"_n": n, "_v": v})
    p = p.withColumns({"_low": F.greatest(F.floor(share * (h - F.col("_n") / 2) + 0.5) - 1, F.lit(0)).cast("long"), "_high": F.when(F.col(votes) > 0, F.floor(share * (h + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long")})
    certain = F.sum("_low").over(g)
    asked = p.select(*group, key, votes, seats, "_low", "_high", certain.alias("_certain")).where("_high > _low")
    asked = asked.select(*group, key, (F.col(seats) - F.col("_certain")).alias("_left"), F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_j"), votes)
    place = F.row_number().over(g.orderBy(F.desc(F.col(votes) / (2 * F.col("_j") + 1)), key, "_j"))
    won = asked.withColumn("_place", place).where("_place <= _left").groupBy(*group, key).agg(F.count("*").alias("_won"))
    return p.join(won, [*group, key], "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_n", "_v", "_low", "_high", "_won")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, _rank, source_size, _docs, target: of each source of rows (source, size)."""
    order, every = Window.orderBy(F.asc_nulls_last("_source")), Window.partitionBy(F.lit(0))
    s = rows.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    s = s.withColumn("_rank", F.row_number().over(order).cast("long"))
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = most * F.col("source_size")
    before = Window.orderBy(cap / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_cap": cap, "_cb": F.coalesce(F.sum(cap).over(before), F.lit(0)), "_wb": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_t": F.sum("source_size").over(every), "_ws": F.sum("_w").over(every)})
    big = lambda c: c.cast("decimal(19,0)")
    s = s.withColumn("_full", big(F.col("_cap")) * big(F.col("_ws") - F.col("_wb")) <= big(F.col("_w")) * big(F.col("_t") - F.col("_cb")))
    full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0)).over(every)
    s = s.withColumns({"_left": F.col("_t") - full("_cap"), "_wl": F.col("_ws") - full("_w")})
    level = (F.col("_w") * F.col("_left")).cast("double") / F.col("_wl").cast("double")
    return s.select("_source", "_rank", "source_size", "_docs", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level).alias("target"))


def plan(rows: DataFrame, weights: tuple[int, ...], most: int, block: int, shard_rows: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The sources with target and quota, and the shards with theirs, for rows (doc_id, source, size, _text)."""
    s = targets(rows, weights, most).withColumn("_all", F.lit(0))
    s = s.withColumn("_house", F.floor(F.sum("target").over(Window.partitionBy("_all")) / block + 0.5))
    s = cut(sainte_lague(s, ["_all"], "_rank", "target", "_house", "_quota").withColumn("_shards", F.ceil(F.col("_docs") / shard_rows)).select("_source", "_rank", "source_size", "target", "_quota", "_shards"))
    shards = placed(rows.select("doc_id", "source", "size", "_text"), s, seed).groupBy("_rank", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    shards = sainte_lague(shards, ["_rank"], "_shard", "_words", "_quota", "_blocks")
    whole = F.ceil(F.col("_words") / block).cast("long")
    shards = shards.select("_rank", "_shard", "_words", whole.alias("_whole"), F.least("_blocks", most * whole).alias("_blocks"))
    first = dealt(F.md5(F.concat_ws(":", F.lit(seed), F.col("_rank").cast("string"), F.col("_shard").cast("string"))), 1)
    shards = shards.where("_whole > 0").select("_rank", "_shard", "_words", F.expr("_blocks div _whole").alias("_passes"), F.expr("_blocks % _whole").alias("_run"), (first % F.col("_whole")).alias("_first"))
    return s, shards


def placed(rows: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """rows with those columns of their source that start with an underscore, its size and target, their shard and their digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_text")))
    both = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_digest", digest)
    return both.withColumn("_shard", dealt(F.col("_digest"), 1) % F.col("_shards"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED, sized: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, source, size, _text, and any others) with source_size, target, taken: the words that the mix takes of each, and _from, the word of it at which what is taken beyond whole passes starts.

    sized: rows (doc_id, source, size, _text) of the same table, if that is cheaper to read again.
    """
    s, shards = plan(sized if sized is not None else rows, weights, most, block, shard_rows, seed)
    keep = [*rows.columns, "source_size", "target", "_rank", "_shard", "_digest"]
    line = Window.partitionBy("_rank", "_shard").orderBy(F.substring("_digest", 9, 24), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed(rows, s, seed).select(keep).withColumn("_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    laid = laid.join(shards, ["_rank", "_shard"], "left")
    until = F.col("_first") + F.col("_run")
    a, b = F.col("_first") * block, F.least(until * block, F.col("_words"))
    c = F.greatest((until - F.expr("(_words + {0} - 1) div {0}".format(block))) * block, F.lit(0))
    end = F.col("_at") + F.col("size")
    over = lambda x, y: F.greatest(F.least(y, end) - F.greatest(x, F.col("_at")), F.lit(0))
    laid = laid.withColumns({"_late": over(a, b), "_early": over(F.lit(0), c)})
    taken = F.when(F.col("_passes").isNull(), 0).otherwise(F.col("_passes") * F.col("size") + F.col("_late") + F.col("_early")).cast("long")
    return laid.withColumns({"taken": taken, "_from": F.when(F.col("_early") > 0, 0).otherwise(F.greatest(a - F.col("_at"), F.lit(0)))}).select(*rows.columns, "source_size", "target", "taken", "_from")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    rows = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), text_digest()))
    return mix(rows, **options).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as whole passes take it, and once more what a run of blocks takes of it (all of it but at a run's ends)."""
    names = docs.columns
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), text_digest()))
    others = [c for c in names if c not in ("doc_id", "source", "text", "n_chars")]
    rows = docs.select("doc_id", "source", "text", size_of(F.col("text")).alias("size"), text_digest(), *[F.col(c).alias(f"_other_{c}") for c in others])
    rows = mix(rows, sized=sized, **options).where("taken > 0")
    copies = F.expr("cast(taken div size as int)")
    part = F.col("taken") % F.col("size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), part.cast("int")), " ")
    texts = F.when(part == 0, F.array_repeat("text", copies)).otherwise(F.concat(F.array_repeat("text", copies), F.array(some)))
    out = rows.withColumn("_text", F.explode(texts))
    new = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select([(new[c] if c in new else F.col(f"_other_{c}")).alias(c) for c in names])
