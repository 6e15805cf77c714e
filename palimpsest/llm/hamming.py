"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments, and each segment has an index of the codes by its value. For a query the search
radius in the segments grows: at radius r, all values of segment j at r differing bits are looked up, and the codes
found there are verified by their whole distance. Once segments 0 to j have been searched at radius r, every
code within segments * r + j differing bits has been met; the search ends when the kth smallest verified distance
is within that, so no nearer code, and none of equal distance, is missed.

Rows are dealt by a hash of their id to shards of bounded size, as large as memory allows, since the work that a query is in a
shard grows by far less than the shard does. Queries are taken in blocks of bounded size, smaller ones only as far as
there are cores to fill, and each pair of a shard and a block is one task's work, whose k nearest a query are merged over the
shards. Equal codes are one entry of an index, with their ids in order, so that no group of copies is searched twice.

Defined results: rows without an id or an embedding have no code, and are neither found nor searched for;
a code has one bit for each of the first `bits` numbers, set if it is above zero (missing, null and NaN: not);
a query doesn't find rows of its own id; ties go to the smaller id; rows that repeat are found as often as they
stand, and searched for as often; fewer than k other rows give fewer results; an empty table gives no rows;
other columns are left out whatever their names.
"""

from __future__ import annotations

import heapq
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut
from palimpsest.runtime import ship

#: A shard of that many rows takes about 100 MB of a task with its index.
BITS, SHARD_ROWS, BLOCK_ROWS = 64, 1 << 20, 1 << 16
#: Queries that make a block at least, where blocks are cut smaller for the cores' sake.
FEW_ROWS = 32
#: Partitions of the pairs at most; beyond, a task has several.
MOST_PARTS = 20_000


def code_of(embedding: Column, bits: int = BITS) -> Column:
    """The signs of the first numbers as an integer, the first number's in the lowest bit."""
    one = [F.when((F.get(embedding, i) > 0) & ~F.isnan(F.get(embedding, i)), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)).cast("long") for i in range(bits)]
    return reduce(Column.bitwiseOR, one)


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All values of that many bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Distinct codes (unsigned 64-bit) with their ids, indexed by segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int = BITS, segments: int = 0) -> None:
        order = np.lexsort((ids, codes))
        self.ids = ids[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(ids))
        # a segment about as wide as the number of codes has bits, so that a value has about one code
        segments = segments or max(1, round(bits / max(4, min(20, len(self.codes).bit_length() - 1))))
        at = [bits * i // segments for i in range(segments + 1)]
        self.parts = [(np.uint64(a), b - a) for a, b in zip(at, at[1:], strict=False)]
        self.order, self.starts = [], []
        for a, width in self.parts:
            value = self.segment(self.codes, a, width)
            self.order.append(np.argsort(value, kind="stable").astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))]).astype(np.int32))
        self.seen = np.zeros(len(self.codes), bool)

    @staticmethod
    def segment(codes: np.ndarray, a: np.uint64, width: int) -> np.ndarray:
        return ((codes >> a) & np.uint64((1 << width) - 1)).astype(np.int64)

    def nearest(self, code: np.uint64, own: int, k: int) -> list[tuple[int, int]]:
        """(distance, id) of the k nearest, by distance and then id, rows of the own id left out."""
        best: list[tuple[int, int]] = []
        met, m = [], len(self.parts)
        values_of = [int(self.segment(np.array([code]), a, width)[0]) for a, width in self.parts]
        for radius in range(max(w for _, w in self.parts) + 1):
            for j, (_, width) in enumerate(self.parts):
                if radius <= width:
                    values = masks(width, radius) ^ values_of[j]
                    lo, hi = self.starts[j][values], self.starts[j][values + 1]
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        lo, size = lo[some].astype(np.int64), (hi[some] - lo[some]).astype(np.int64)
                        ends = np.cumsum(size)
                        at = self.order[j][np.repeat(lo - ends + size, size) + np.arange(ends[-1])]
                        at = at[~self.seen[at]]
                        self.seen[at] = True
                        met.append(at)
                        d = np.bitwise_count(self.codes[at] ^ code)
                        if len(best) == k:  # an equal distance may still have a smaller id
                            close = d <= best[-1][0]
                            at, d = at[close], d[close]
                        if len(at):
                            best = self.merged(best, at, d, own, k)
                if len(best) == k and best[-1][0] <= m * radius + j:
                    self.seen[np.concatenate(met)] = False
                    return best
        self.seen[:] = False
        return best

    def merged(self, best: list[tuple[int, int]], at: np.ndarray, d: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k nearest of what there is and the ids of the codes `at`, at distances d."""
        found = list(best)
        for distance in np.unique(d):
            if len(found) - len(best) >= k:
                break
            of_distance = []
            for c in at[d == distance]:
                first, after = self.first[c], self.first[c + 1]
                # of one code's ids k besides the own one are enough
                mine = self.ids[first:after]
                if after - first > 1:
                    before, behind = np.searchsorted(mine, [own, own + 1])
                    mine = np.concatenate([mine[: min(before, k)], mine[behind : behind + k]])[:k]
                of_distance += [(int(distance), int(i)) for i in mine if i != own]
            found += heapq.nsmallest(k, of_distance)
        return heapq.nsmallest(k, found)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, distance of the k rows nearest to each query; both tables: vec_id, embedding."""
    spark = rows.sparkSession
    ship(spark)
    coded = lambda df: df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), code_of(F.col("embedding"), bits).alias("code"))
    data, asked = cut(coded(rows)), cut(coded(queries).withColumn("query", F.monotonically_increasing_id()))
    n_asked = asked.count()
    shards = max(1, -(-data.count() // shard_rows))
    idle = -(-2 * spark.sparkContext.defaultParallelism // shards)
    blocks = max(1, -(-n_asked // block_rows), min(idle, -(-n_asked // FEW_ROWS)))
    dealt = lambda df, key, n: F.pmod(F.xxhash64(key), F.lit(n))
    left = data.select(dealt(data, "vec_id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "code")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"), dealt(asked, "query", blocks).cast("int").alias("block"), "query", "vec_id", "code")

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            index = MultiIndex(x["code"].to_numpy(np.int64).view(np.uint64), x["vec_id"].to_numpy(np.int64), bits)
            for query, own, code in zip(q["query"], q["vec_id"], q["code"].to_numpy(np.int64).view(np.uint64), strict=True):
                out += [(query, own, d, i) for d, i in index.nearest(code, own, k)]
        return pd.DataFrame(out, columns=["query", "query_id", "distance", "vec_id"]).astype("int64")

    # numbers of one's own: small as the rows are, each pair is much work, and partitions are not to be put together
    n = min(shards * blocks, MOST_PARTS)
    left, right = (df.repartition(n, "shard", "block") for df in (left, right))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query long, query_id long, distance long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "distance")
