"""Fingerprints, near-duplicates, mixing, tokens and records, against brute force and libraries."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import bpe, mixing, queries, records, simhash, syncmers
from palimpsest.llm.common import table

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# op 1


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    points = syncmers.code_points(text)
    inner = syncmers.run_hashes(points, s).tolist()
    return [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


def test_closed_syncmers_by_brute_force():
    rnd = random.Random(5)
    for n in (24, 25, 60, 500):
        text = "".join(rnd.choice("ab é𝔘") for _ in range(n))
        assert syncmers.anchors(text).at.tolist() == brute_anchors(text)


def test_anchors_do_not_depend_on_what_is_around(monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    whole = syncmers.anchors(text)
    part = syncmers.anchors(text[1000:2000])
    inside = {(int(a) - 1000, int(h)) for a, h in zip(whole.at, whole.hashes) if 1000 <= a <= 2000 - syncmers.K}
    assert inside == {(int(a), int(h)) for a, h in zip(part.at, part.hashes)}
    monkeypatch.setattr(syncmers, "PART", 100)
    again = syncmers.anchors(text)
    assert again.at.tolist() == whole.at.tolist() and again.hashes.tolist() == whole.hashes.tolist()


def test_op1(spark, sf_dir, docs):
    got = queries.op1_closed_syncmers(spark, sf_dir).toPandas().set_index("doc_id")
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    assert sorted(got.index) == sorted(texts)
    for i, d in enumerate(order):
        text, other = texts[d], texts[order[(i + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        row = got.loc[d]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (syncmers.sketch(syncmers.anchors(t)) for t in (text, edited, other))
        assert row["fingerprint"] == syncmers.as_text(a) and row["edited_fingerprint"] == syncmers.as_text(b)
        assert row["near_edited"] == syncmers.likeness(a, b) and row["near_next"] == syncmers.likeness(a, c)


def test_succession_over_many_buckets(spark):
    rows = spark.createDataFrame([(i * 7 % 1000, f"text number {i * 7 % 1000} " * 5) for i in range(1000)], "doc_id long, text string")
    placed = syncmers.in_succession(rows, rows=50).collect()
    heads = collections.defaultdict(list)
    for r in placed:
        heads[r["bucket"]].append((r["guest"], r["doc_id"]))
    assert len(heads) > 10
    buckets = sorted(heads)
    for i, b in enumerate(buckets):
        after = heads[buckets[(i + 1) % len(buckets)]]
        assert [d for g, d in heads[b] if g] == [max(d for g, d in after if not g)]


def test_succession_of_shared_ids(spark):
    """Rows without an id and rows of one id are spread over buckets, and still follow one another in order."""
    rnd = random.Random(13)
    rows = [(rnd.choice([None, 7, rnd.randrange(40)]), f"text {rnd.randrange(400)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["bucket"]) for r in syncmers.in_succession(df, rows=30).collect() if not r["guest"])
    assert len(got) == 900 and len({g[3] for g in got if not g[0]}) > 3 and len({g[3] for g in got if g[:2] == (True, 7)}) > 3
    assert [g[3] for g in got] == sorted((g[3] for g in got), reverse=True)


def test_op1_odd(odd, none):
    got = syncmers.fingerprints(odd).collect()
    assert len(got) == odd.count() and syncmers.fingerprints(none).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[3]["fingerprint"] == "" and by[6]["n_chars"] == 1
    assert syncmers.with_anchors(odd).count() == odd.count()
    one = odd.where("doc_id = 1")
    assert syncmers.fingerprints(one).first()["near_next"] == 1.0


def test_texts_without_a_syncmer_are_unlike():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(24, 39))) for _ in range(200)]
    bare = [t for t in texts if not brute_anchors(t)]
    prints = [syncmers.sketch(syncmers.anchors(t)) for t in bare]
    assert len(bare) > 20 and all(len(p) == 1 for p in prints) and len({syncmers.as_text(p) for p in prints}) == len(bare)
    assert syncmers.likeness(prints[0], prints[1]) == 0.0 and syncmers.likeness(prints[0], prints[0]) == 1.0


# op 2


def slow_simhash(text, width=3):
    words = [w for w in text.encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(values, linked):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_op2(spark, sf_dir, docs):
    got = queries.op2_simhash_bk_tree(spark, sf_dir).toPandas()
    texts = texts_of(docs)
    fps = {d: slow_simhash(t) for d, t in texts.items()}
    want = closure(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_bk_tree_finds_all():
    rnd = random.Random(1)
    values = [rnd.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree(values)
    for q in range(0, 1024, 37):
        assert sorted(tree.near(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_split_shards_lose_no_link(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    small, large = (simhash.components(simhash.links(df, 2, size)).toPandas() for size in (16, 4096))
    mask = (1 << 64) - 1
    want = closure(sorted(signed), lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    for got in (small, large):
        root = {r.node: r.root for r in got.itertuples()}
        assert {f: root.get(f, f) for f in signed} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_op2_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["fingerprint"] == "0" * 16 and by[4]["component_id"] == 3 == by[7]["component_id"]
    assert simhash.simhash(b"x " * 3_000_000) == slow_simhash("x x x")


def test_near_texts(spark, odd, none):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], {}
    for g in range(30):
        text = [rnd.choice(words) for _ in range(300)]
        for c in range(4):
            copy = list(text)
            for _ in range(c):
                copy[rnd.randrange(300)] = rnd.choice(words)
            rows.append((g * 10 + c, " ".join(copy)))
            want[g * 10 + c] = g * 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(df).collect()}
    assert got == want
    kept = simhash.keep_one(df, simhash.near_texts(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_texts(none).count() == 0
    left = simhash.keep_one(odd, simhash.near_texts(odd))
    assert left.columns == odd.columns and [r["doc_id"] for r in left.orderBy("doc_id").collect()].count(6) == 1


def brute_shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_likeness(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b)


def test_near_texts_are_checked_by_their_shingles(spark):
    """Pairs from 0.6 to 0.95, most of them within the radius: of them just those at 0.8 or more may be linked."""
    rnd = random.Random(7)
    texts = []
    for g in range(60):
        common = [f"c{g}x{i}" for i in range(rnd.randrange(200, 400))]
        own = int(len(common) * (1 / (0.6 + 0.35 * g / 59) - 1) / 2)
        texts += [" ".join(common + [f"{s}{g}x{i}" for i in range(own)]) for s in "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (4096, 8):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(df, tree_size=size).collect()}
        near = {i: brute_likeness(texts[i - i % 2], texts[i - i % 2 + 1]) for i in range(120)}
        below, above = ([i for i in near if near[i] < 0.8], [i for i in near if near[i] > 0.87])
        assert len(below) > 40 and {i: got[i] for i in below} == {i: i for i in below}
        assert len(above) > 20 and {i: got[i] for i in above} == {i: i - i % 2 for i in above}


def test_pairs_at_the_likeness_are_found(spark):
    """Short texts, texts at just 0.8, and a copy with a line that it repeats."""
    rnd = random.Random(8)
    word = lambda: f"{rnd.getrandbits(40):x}"
    texts = []
    for fewer, more in [(4, 5), (6, 7), (12, 15), (240, 300)] * 10:
        text = [word() for _ in range(more + 4)]
        texts += [text[: fewer + 4], text]
    for _ in range(10):
        text = [word() for _ in range(204)]
        texts += [text, text + text[:12] * 49]
    texts = [" ".join(t) for t in texts]
    assert all(brute_likeness(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_texts(df).collect()} == {i: i - i % 2 for i in range(100)}


def test_keep_one_of_each_component(spark):
    """Rows without an id, and rows of one id with unlike texts, are kept by component; rows that repeat are one."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, c), (7, c), (5, a + " more"), (5, d), (9, d), (9, "else"), (9, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df, simhash.near_texts(df))
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([(None, b), (5, a + " more"), (5, d), (7, c), (9, "else")], key=str)


# op 7


def brute_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_sainte_lague_by_hand(spark):
    rnd = random.Random(4)
    for n, seats in ((1, 5), (3, 0), (7, 20), (40, 13), (12, 500)):
        votes = [rnd.choice([0, 1, 5, 5, 100, 1000]) for _ in range(n)]
        if not sum(votes):
            votes[0] = 3
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v long, h long")
        got = {r["k"]: r["q"] for r in mixing.sainte_lague(df, ["g"], "k", "v", "h", "q").collect()}
        assert [got[i] for i in range(n)] == brute_seats(votes, seats)


def test_op7_near_targets(spark, sf_dir, docs):
    got = queries.op7_sainte_lague_mix(spark, sf_dir).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == docs.count() and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), told=("source_size", "first"))
    assert (by["size"] == by["told"]).all() and ((by["taken"] - by["target"]).abs() <= 2 * mixing.BLOCK + 0.004 * by["target"]).all()
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-6 * by["size"].sum() and (by["target"] <= 3 * by["size"] + 1e-9).all()


def test_targets_reshare(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(rows).collect()}
    # a and null stop at 30 and 270; b has 2 and c has 1 of what is left
    assert got["a"] == 30 and got[None] == 270 and got["b"] == pytest.approx(1800 * 2 / 3) and got["c"] == pytest.approx(600)


def test_many_shards_and_the_mix_itself(spark, docs):
    by = mixing.mixed(docs, shard_rows=3).toPandas()
    assert by["taken"].sum() == pytest.approx(by["size"].sum(), rel=0.05)
    mixed, out = mixing.mixed(docs).toPandas(), mixing.repeated(docs)
    assert out.columns == docs.columns
    words = out.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).toPandas().set_index("doc_id")["n"]
    taken = mixed[mixed["taken"] > 0].set_index("doc_id")["taken"]
    assert words.sort_index().tolist() == taken.sort_index().tolist()


def test_op7_odd(odd, none):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and mixing.mixed(none).count() == 0
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    out = mixing.repeated(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert sorted(map(tuple, mixing.mixed(odd).collect()), key=repr) == sorted(map(tuple, got), key=repr)


# op 8 and op 10


def test_segment_tree_gives_the_leftmost_lowest_rank():
    v = bpe.words_of(PATH).vocabulary
    rnd = random.Random(8)
    for _ in range(300):
        raw = bytes(rnd.choice(b"theinganouer") for _ in range(rnd.randrange(1, 40)))
        ids = [v.inner[b] for b in raw[:-1]] + [v.last[raw[-1]]]
        while True:
            ranks = [(v.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in v.merges]
            if not ranks:
                break
            i = min(ranks)[1]
            ids[i : i + 2] = [v.merges[ids[i], ids[i + 1]][1]]
        assert v.merge(raw) == ids


POOL = [chr(c) for c in range(1, 300)] + list("́̈ͅΣσςİẞK℃ﬁ你好가각😀‍①²½ \u0085 　")
ODD_TEXTS = ["it's we'LL I'RE <|endoftext|>a<|startoftext|> <|x|>", "", " ", "ΑΣ ΟΔΟΣ", "a" * 5000, "ab\x1ccd", "''s", "x" * 70 + " " + "x" * 70]


def test_encoders_agree_with_the_library(library, docs):
    rnd = random.Random(9)
    texts = ODD_TEXTS + ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(60))) for _ in range(3000)] + list(texts_of(docs).values())
    words, encoder = bpe.words_of(PATH), records.encoder(PATH)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = bpe.encode_text(words, text.encode())
        assert np.frombuffer(ids, "<i4").tolist() == want and decoded.decode() == library.decode(want, skip_special_tokens=False)
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == want


def test_caches_stay_small(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(records, "CACHE_WORDS", 10)
    words, encoder = bpe.Words(bpe.Vocabulary(PATH)), records.Encoder(PATH)
    text = " ".join(f"word{i % 50}x" for i in range(500)).encode()
    assert np.array_equal(np.frombuffer(bpe.encode_text(words, text)[0], "<i4"), np.frombuffer(encoder.encode(text), "<u2"))
    assert len(words) <= 10 and len(words.old) <= 10
    for i in range(50):
        text = f"one{i} two{i % 7} three{i} " + "long" * 30
        assert np.array_equal(np.frombuffer(bpe.encode_text(words, text.encode())[0], "<i4"), np.frombuffer(encoder.encode(text.encode()), "<u2"))
        assert len(encoder) <= 10 and len(encoder.old) <= 50


def test_op8(spark, sf_dir, docs, library):
    got = queries.op8_bpe_segment_tree(spark, sf_dir).toPandas().set_index("doc_id")
    for d, text in texts_of(docs).items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got.loc[d, "n_tokens"] == len(ids) and got.loc[d, "ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.loc[d, "decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10(spark, sf_dir, docs, library):
    got = queries.op10_token_records(spark, sf_dir).toPandas().set_index("doc_id")
    texts, start = texts_of(docs), 0
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 2]
        assert got.loc[d].tolist() == [start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]
        start += len(ids)


def test_records_by_index_and_damage(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/r"
    files = records.write(docs, PATH, folder, file_rows=30)
    assert files.count() > 3
    rows = records.read_all(folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts_of(docs))
    counts = [r["docs"] for r in files.orderBy("file").collect()]
    assert records.read_one(folder, 1, 2) == (rows[counts[0] + 2]["doc_id"], rows[counts[0] + 2]["ids"])
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_attempt")]
    part = tmp_path / "r" / "part-000000"
    index = bytearray(part.with_suffix(".idx").read_bytes())
    assert len(index) == 24 * counts[0]
    good = bytes(index)
    for at in (0, 8):  # an offset, a length
        index[24 + at] ^= 1
        part.with_suffix(".idx").write_bytes(index)
        with pytest.raises(ValueError):
            records.read_one(folder, 0, 1)
        with pytest.raises(Exception, match="damaged"):
            records.read_all(folder, files).count()
        index[24 + at] ^= 1
    part.with_suffix(".idx").write_bytes(good)
    data = bytearray(part.with_suffix(".rec").read_bytes())
    data[30] ^= 1
    part.with_suffix(".rec").write_bytes(data)
    with pytest.raises(ValueError):
        records.read_one(folder, 0, 0)
    assert records.read_one(folder, 0, 1)


def test_tokens_odd(odd, none, library):
    got = bpe.encode_decode(odd, PATH).collect()
    assert len(got) == odd.count() and bpe.encode_decode(none, PATH).count() == 0 == records.written_and_read(none, PATH).count()
    assert {tuple(r["ids"]) for r in got if r["doc_id"] in (3, 4, 7)} >= {()}
    read = records.written_and_read(odd, PATH).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8] and read[0]["start"] == 0
    assert all(r["ids"][-1] == 2 for r in read)
