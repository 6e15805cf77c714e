"""SimHash fingerprints, and groups of documents whose fingerprints differ in few bits, by BK-trees.

A link joins two fingerprints at `radius` or fewer differing bits. Of 64 bits dealt into radius + 1
segments, two linked fingerprints agree on one segment at least, so the distinct fingerprints are
sharded by (segment, its value), each shard builds a BK-tree of bounded size, and only the members of
a shard search its tree. A shard above `tree_size` is split into several trees, and each of its
members goes to all of them; no pair is lost, and no task holds more than one tree.

Defined results: a null text counts as empty; no words give fingerprint zero, which links like any
other; exact copies share a fingerprint and so a component; rows that repeat stay repeated; a null
doc_id keeps its row, and is never the smallest of a component that has other ids; an empty table gives
no rows; other columns are left out of the result whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import by_batch, cut, helpers, text_or_empty, word_lists

BITS, SEED = 64, 42


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `width` words, joined by a space; fewer words make one run."""
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return np.array([h(joined[a:b], seed) for a, b in zip((ends - sizes).tolist(), ends[width - 1 :].tolist(), strict=False)], np.uint64)


def simhash(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats included."""
    ones, n = np.zeros(BITS, np.int64), 0
    for k, words in enumerate(word_lists(text.lower(), width - 1)):
        if k and len(words) < width:
            continue
        hashes = shingle_hashes(words, width, seed)
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, and fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_buffer().to_pybytes(), width, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return by_batch(docs.select("doc_id", text_or_empty()), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self, values: Iterable[int] = ()) -> None:
        self.root: tuple[int, dict] | None = None
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        own, children = self.root
        while d := (own ^ value).bit_count():
            if (node := children.get(d)) is None:
                children[d] = (value, {})
                return
            own, children = node

    def near(self, value: int, radius: int) -> list[int]:
        """All values of the tree within the radius: only edges from d - radius to d + radius lead there."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if len(children) > 2 * radius + 1:
                todo += [children[e] for e in range(max(1, d - radius), d + radius + 1) if e in children]
            else:
                todo += [node for e, node in children.items() if -radius <= e - d <= radius]
        return found


class Forest:
    """Union-find over the few values that were joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def segments(n: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of n segments of nearly equal width."""
    at = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


#: Parts in which the rows of one key meet its value.
SALTS = 8


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """many joined with one (a row for each key), the rows of a key dealt over several tasks by a hash of `by`."""
    parts = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(parts, [key, "_salt"]).drop("_salt")


def split_shards(keyed: DataFrame, tree_size: int, tree_bytes: int | None = None) -> DataFrame:
    """keyed (shard, node, code, and others) with tree and guest, without shards of one member, which have no links: a shard above tree_size, or whose `size` adds up to more than tree_bytes, is several trees, and a member goes to its own and, as a guest, to those after it."""
    trees = F.ceil(F.count("*") / tree_size)
    if tree_bytes:
        trees = F.greatest(trees, F.ceil(F.sum("size") / tree_bytes))
    shards = keyed.groupBy("shard").agg(F.count("*").alias("members"), trees.cast("int").alias("trees")).where("members > 1").select("shard", "trees")
    dealt = salted_join(keyed, shards, "shard", "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
    dealt = dealt.withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1))).withColumn("guest", F.col("tree") > F.col("own"))
    return dealt.select(*keyed.columns, "tree", "guest")


def tree_links(keyed: DataFrame, radius: int, tree_size: int) -> DataFrame:
    """Pairs (a, b) of nodes of one shard whose codes (binary) are within the radius: of each tree, a spanning forest of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, forest, node_of = None, BKTree(), Forest(), {}
        for b in batches:
            a_col, b_col = [], []
            for shard, k, guest, node, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = int.from_bytes(code)
                if (shard, k) != at:
                    at, tree, forest, node_of = (shard, k), BKTree([value]), Forest(), {value: node}
                    continue
                near = [node_of[v] for v in tree.near(value, radius)]
                if guest:  # not kept: the forest holds members of the tree only
                    near[1:] = [x for x in near[1:] if forest.join(near[0], x)]
                else:
                    near = [x for x in near if forest.join(node, x)]
                    if value not in node_of:
                        tree.add(value)
                        node_of[value] = node
                a_col += [node] * len(near)
                b_col += near
            if a_col:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a_col, b_col)], ["a", "b"])

    dealt = split_shards(keyed, tree_size).select("shard", "tree", "guest", "node", "code").repartition("shard", "tree")
    return by_batch(dealt.sortWithinPartitions("shard", "tree", "guest", "node"), run, "a long, b long")


def links(fps: DataFrame, radius: int, tree_size: int = 4096) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints fp of which the links are a closure."""
    parts = F.array(*[F.lit(i << 56).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1))) for i, (a, w) in enumerate(segments(radius + 1))])
    return tree_links(fps.select(F.explode(parts).alias("shard"), F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("code")), radius, tree_size)


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the pairs (a, b) but the roots. Large-star and small-star rounds, each cut from its lineage, until nothing changes."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == seen or not now["n"]:
            break
        seen = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        edges = cut(small.where("u > v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, tree_size: int = 4096, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable by links), a row for each row of docs."""
    rows = cut(fingerprints(docs, width, seed))
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = in_components(rows, groups, links(groups.select("fp"), radius, tree_size))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Seeds of a wide fingerprint's words, and the bands of min-hashes that shard it: (bands, min-hashes a band).
WIDE_WORDS, BANDS = 4, (10, 2)


def scattered(x: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of the hashes, for each k."""
    x = (x ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """The hashes of the text's different word shingles, in order."""
    lists = enumerate(word_lists(text.lower(), width - 1))
    return np.unique(np.concatenate([shingle_hashes(some, width, seed) for k, some in lists if not k or len(some) >= width]))


def alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether the Jaccard likeness of two ordered sets is `likeness` or more."""
    small, large = sorted((len(a), len(b)))
    if not small or small / large < likeness:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (small + large - common) >= likeness


def wide_simhash(text: bytes, width: int, words: int = WIDE_WORDS, bands: tuple[int, int] = BANDS, seed: int = SEED) -> tuple[bytes, list[int], int]:
    """A fingerprint of 64 bits a word, the band keys, and a hash of the set, all of the text's different shingles; the bands of one text differ from each other."""
    hashes = shingle_set(text, width, seed)
    ones, n_min = np.zeros(64 * words, np.int64), bands[0] * bands[1]
    least = np.full(n_min, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for w in range(words):
            bits = np.unpackbits(scattered(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * w : 64 * w + 64] += bits.sum(axis=0, dtype=np.int32)
        for i in range(n_min):
            least[i] = min(least[i], scattered(part, words + i).min())
    code = np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()
    keys = [xxhash.xxh64_intdigest(least[i * bands[1] : (i + 1) * bands[1]].tobytes(), i) for i in range(bands[0])]
    return code, [k - (1 << 64) if k >> 63 else k for k in keys], int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed))))


def bit_odds(common: int, only_a: int, only_b: int) -> float:
    """The chance that a bit differs between the codes of two sets, as it is set in over half of the hashes of each."""

    def shares(n: int) -> np.ndarray:
        return np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n

    def is_set(more: int) -> np.ndarray:
        k, x = np.arange(common + 1)[:, None], np.arange(more + 1)
        return ((2 * (k + x) > common + more) * shares(more)).sum(axis=1)

    a, b = is_set(only_a), is_set(only_b)
    return float((shares(common) * (a * (1 - b) + b * (1 - a))).sum())


@lru_cache
def radius_of(likeness: float, bits: int, slack: float = 4.0) -> int:
    """The bits in which two texts of that Jaccard likeness differ at most, but for four standard deviations (3 in 100,000): by the pair of sizes whose bits differ most.

    Long texts differ by their angle, whose cosine is 2 J / (1 + J). With few shingles a bit more often hangs on a tie, so these
    are counted out: at 0.8 the worst are 4 against 5 shingles, of which 48 of 256 bits differ on average.
    """
    odds = [float(np.arccos(2 * likeness / (1 + likeness)) / np.pi)]
    for union in range(1, 65):
        common = next(c for c in range(union + 1) if c / union >= likeness)
        odds += [bit_odds(common, i, union - common - i) for i in range((union - common) // 2 + 1)]
    p = max(odds)
    return int(np.ceil(bits * p + slack * (bits * p * (1 - p)) ** 0.5))


#: Bytes of text that a tree holds, if that is more than one.
TREE_BYTES = 64 << 20


def alike_links(dealt: DataFrame, radius: int, width: int, likeness: float, seed: int = SEED) -> DataFrame:
    """Pairs (a, b) of nodes of one tree whose texts' shingles are alike: the tree's codes within the radius are candidates, and each pair is checked before it joins the tree's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, forest, nodes_of, kept = None, BKTree(), Forest(), {}, {}

        def of(x: int) -> np.ndarray:
            if isinstance(kept[x], bytes):
                kept[x] = shingle_set(kept[x], width, seed)
            return kept[x]

        for b in batches:
            a_col, b_col = [], []
            for shard, k, guest, node, code, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = int.from_bytes(code)
                if (shard, k) != at:
                    at, tree, forest, nodes_of, kept = (shard, k), BKTree(), Forest(), {}, {}
                kept[node] = text.encode()
                first = None
                for x in (x for v in tree.near(value, radius) for x in nodes_of[v]):
                    if first is not None and forest.find(x) == forest.find(first) or not alike(of(node), of(x), likeness):
                        continue
                    if first is None:
                        first = x
                    forest.join(first, x)
                    a_col.append(node)
                    b_col.append(x)
                if guest:  # not kept: the forest holds members of the tree only
                    del kept[node]
                    continue
                if first is not None:
                    forest.join(first, node)
                tree.add(value)
                nodes_of.setdefault(value, []).append(node)
            if a_col:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a_col, b_col)], ["a", "b"])

    dealt = dealt.select("shard", "tree", "guest", "node", "code", "text").repartition("shard", "tree")
    return by_batch(dealt.sortWithinPartitions("shard", "tree", "guest", "node"), run, "a long, b long")


def text_hash() -> Column:
    return F.xxhash64(text_or_empty()).alias("text_hash")


def near_texts(docs: DataFrame, width: int = 5, likeness: float = 0.8, words: int = WIDE_WORDS, bands: tuple[int, int] = BANDS, tree_size: int = 4096, seed: int = SEED) -> DataFrame:
    """doc_id, component_id, and what keep_one needs, root (a node of the component) and text_hash: documents whose sets of shingles are alike by `likeness` or more, pair by pair, and what such pairs connect.

    At such a radius no segment of a fingerprint need be equal, so the shards are bands of min-hashes of the shingles: two texts
    share a band with a chance of likeness ** min-hashes a band each, and at 0.8 miss all 10 bands of 2 four times in 100,000.
    Only members of shards of two or more have their texts read again, for the check of the candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [wide_simhash(t.as_buffer().to_pybytes(), width, words, bands, seed) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.binary_length(b.column(2)), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "text_hash", "size", "node", "code", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(by_batch(docs.select("doc_id", text_hash(), text_or_empty()), run, f"doc_id {kind}, text_hash long, size int, node long, code binary, bands array<long>"))
    one = F.min(F.struct("text_hash", "size")).alias("one")
    texts = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("code").alias("code"), F.min("bands").alias("bands"), one).select("node", "first", "code", "bands", "one.*"))
    dealt = cut(split_shards(texts.select(F.explode("bands").alias("shard"), "node", "code", "size", "text_hash"), tree_size, TREE_BYTES))
    bodies = docs.select(text_hash(), text_or_empty()).groupBy("text_hash").agg(F.first("text").alias("text"))
    bodies = bodies.join(dealt.select("text_hash", "node").distinct(), "text_hash").select("node", "text")
    pairs = alike_links(dealt.join(bodies, "node"), radius_of(likeness, 64 * words), width, likeness, seed)
    found = in_components(rows.select("doc_id", "text_hash", F.col("node").alias("fp")), texts.select(F.col("node").alias("fp"), "first"), pairs)
    return found.select("doc_id", "component_id", "root", "text_hash")


def in_components(rows: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id and root, a node. groups: fp, first (its smallest doc_id)."""
    linked = components(pairs)
    members = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    firsts = members.join(groups.select(F.col("fp").alias("node"), "first"), "node")
    least = firsts.groupBy("root").agg(F.min("first").alias("least"))
    named = salted_join(members, least, "root", "node").select(F.col("node").alias("fp"), "least", "root")
    groups = groups.join(named, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(groups, "fp")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, with one row of each component of found (doc_id, root, text_hash): that of the smallest doc_id, null last; of rows that share it, the one whose text hashes lowest."""
    names = docs.columns
    key, number = (own := helpers(names, "null", "id", "hash", "row"))[:3], own[3]
    at = [c.alias(k) for c, k in zip((F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash")), key, strict=True)]
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("least"))
    kept = least.select("least.*").select(*at)
    rows = docs.select("*", *at[:2], text_hash().alias(key[2])).join(kept, key, "left_semi")
    w = Window.partitionBy(*key).orderBy(F.xxhash64(*names))
    return rows.withColumn(number, F.row_number().over(w)).where(F.col(number) == 1).select(*names)
