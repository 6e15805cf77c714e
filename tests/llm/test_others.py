"""URL rules, nearest codes, main text, the language model, chats and the pipeline, against brute force and fixtures."""

import hashlib
import json
import math
import random
import sys

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import chat, hamming, html_main, kneser_ney, mixing, queries, simhash, urlrules
from palimpsest.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    oracle.same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_adds_them(sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op7_sainte_lague_mix", "op9_chat_tool_links"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# op 3


def test_rules_are_found_by_their_rarest_token():
    rules = [urlrules.Rule("example.com", "/en/", "block"), urlrules.Rule("example.com", "/de", "block"), urlrules.Rule("example.com", "/", "allow"), urlrules.Rule("*", "*/x", "block")]
    index = urlrules.Index(rules)
    assert urlrules.literal_tokens(rules[1]) == {".example", ".com"} and "/en" in index.by_token and index.rest == [rules[3]]
    assert index.best("a.example.com", "/en/1") == rules[0] and index.best("example.com", "/deutsch") == rules[1]
    assert index.best("notexample.com", "/en/") is None and index.best("x.org", "/a/x") == rules[3]


def test_rules_by_brute_force():
    rnd = random.Random(1)
    labels, words = ["a", "b", "com", "net"], ["en", "de", "x-y", ""]
    rules = [urlrules.Rule(".".join(rnd.choices(labels, k=rnd.randint(1, 3))), "/" + "/".join(rnd.choices(words, k=rnd.randint(0, 2))), rnd.choice(["allow", "block"])) for _ in range(60)]
    index = urlrules.Index(rules)
    for _ in range(3000):
        host, path = ".".join(rnd.choices(labels, k=rnd.randint(0, 4))), "".join("/" + w for w in rnd.choices(words, k=rnd.randint(0, 3)))
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
        got = index.best(host, path)
        assert (got and got.text) == (best and best.text)


def test_blocks_of_rules_and_odd_urls(spark, monkeypatch):
    urls = ["HTTP://WWW.Example.COM/en/x?y#z", "http://a.com", "x://b.net/es/", None, "", "no scheme", "://c.net/fr/q", "http://user@d.com:80/", "a://b://c", "http://e.org/cgi-bin/x", "http://\u0130.com/", "x\n://f.com/\n"]
    df = spark.createDataFrame([(i, u, "<html>", "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "", "h", "v")], "page_id long, url string, html string, host string, verdict string")
    whole = urlrules.judge(df, queries.RULES, queries.PATTERNS).collect()
    monkeypatch.setattr(urlrules, "MOST_RULES", 2)
    assert sorted(map(str, urlrules.judge(df, queries.RULES, queries.PATTERNS).collect())) == sorted(map(str, whole))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in whole}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1] == ("a.com", "", None, "allow") and got[2] == ("b.net", "/es/", "net/es/", "block")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow") and got[6][2] == "net/fr/" and got[9][3] == "block" and len(whole) == len(urls) + 1
    assert urlrules.judge(df.where("false"), queries.RULES).count() == 0


# op 4


def test_multi_index_by_brute_force():
    rnd = np.random.default_rng(2)
    for n, k, bits in ((1, 3, 64), (40, 5, 64), (3000, 10, 64), (500, 7, 20)):
        codes = rnd.integers(0, 1 << min(bits, 63), n, dtype=np.uint64)
        codes[: n // 3] = codes[0]
        ids = rnd.permutation(n)
        index = hamming.MultiIndex(codes, ids, bits)
        for i in range(0, n, max(1, n // 12)):
            want = sorted((int(np.bitwise_count(c ^ codes[i])), int(j)) for c, j in zip(codes, ids) if j != ids[i])[:k]
            assert index.nearest(codes[i], int(ids[i]), k) == want


def test_op4_shards_blocks_and_odd(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)], 0) for i in range(200)] + [(200, None, 0), (None, [1.0] * 64, 0), (201, [], 0), (202, [float("nan"), None, 1.0], 0), (203, [1.0] * 70, 0), (5, [1.0] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = df.where("vec_id % 20 = 0 or vec_id > 200")
    one, many = (sorted(map(tuple, hamming.top_k(df, q, 4, shard_rows=s, block_rows=b).collect())) for s, b in ((1 << 20, 1 << 20), (30, 4)))
    assert one == many and len({r[0] for r in one}) == 13
    assert hamming.top_k(df.where("false"), q).count() == 0 == hamming.top_k(df, q.where("false")).count()


# op 5

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1><p>Slogan of the site</p></header>
<div id="cookie-notice"><p>We use cookies, and this is a long sentence that goes on for long about it, so that it looks like prose.</p></div>
<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class="wrap"><%(tag)s class="post"><h1>Title &amp; more</h1><p>First <b>pa</b>ragraph of some length, with &eacute; and text enough to be taken for prose.</p>
<p>Short.</p><script>var x = "</p><p>no</p>";</script><p>Another   paragraph
 with <a href=x>a link</a> in it, of goodly length to count as content.<p>Not closed<br>but broken</%(tag)s>
<aside><p>A sidebar that is long enough to look like content, which it is not, in fact not at all, however long.</p></aside></div>
<form><label>Name</label><input><button>Go</button></form><section id="comments"><p>A reader's comment that goes on for very long, in praise of the article and of its author, without end in sight.</p></section>
<div class="ad-banner">Buy now, buy here, buy everything that we have and more than that, today and tomorrow and always.</div><footer>&copy; foot</footer></body></html>"""
MAIN = ["Title & more", "First paragraph of some length, with é and text enough to be taken for prose.", "Short.", "Another paragraph with a link in it, of goodly length to count as content.", "Not closed", "but broken"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_main.main_blocks(PAGE % {"tag": tag}) == MAIN


def test_main_text_of_the_pages(spark, sf_dir):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.op5_html_main_text(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_main_text_odd(spark):
    pages = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "plain <text", 1), (4, "u", "<p>a<p>b<div class=ad>x</div>c<scr", 1), (5, "u", "<article><p>" + "word " * 100_000, 1), (5, "u", "</div></p><b>t", 1), (6, "u", "<script>x", 1), (7, "u", "<body><table><tr><td>a<td>b</table>", 1)]
    got = [(r["page_id"], " ".join(r["blocks"])[:20]) for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string, blocks int")).collect()]
    assert got == [(1, ""), (2, ""), (None, "plain"), (4, "a b c"), (5, "word word word word "), (5, "t"), (6, ""), (7, "a b")]


ART = "<article><h1>T</h1><p>Long enough text of an article, prose it is and goes on.</p><p>More of the same, with a sentence or two more.</p></article>"
BLOCKS = ["T", "Long enough text of an article, prose it is and goes on.", "More of the same, with a sentence or two more."]


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "site cookie-accepted", "no-sidebar", "ad-free content", "sidebar", "widget page"])
def test_wrappers_are_not_apart(wrapper):
    for art in (ART, ART.replace("article>", "div>")):
        assert html_main.main_blocks(f'<div class="{wrapper}">{art}</div><div class="ad">Buy.</div>') == BLOCKS


def test_several_articles_and_parts_of_one():
    assert html_main.main_blocks(ART + ART) == BLOCKS * 2
    page = ART.replace("</article>", '<section id="related-work"><p>Others did this.</p></section><section class="discussion"><p>We discuss.</p></section><p class="share-price">3</p><div class="ad-slot">buy</div></article>')
    readers = '<div id="comments"><article class="comment"><p>' + "me too " * 100 + "</p></article></div>"
    assert html_main.main_blocks(page + readers) == [*BLOCKS, "Others did this.", "We discuss.", "3"]


@pytest.mark.parametrize("unit", ["<div>a", "<div class=ad>a", "<b>a", "<article><p>a", "<b><article>x</b>", "<span><p>a</b>"])
def test_deep_pages_take_linear_time(unit):
    import time

    start = time.process_time()
    assert html_main.main_blocks(unit * 50_000)
    assert time.process_time() - start < 10


def test_smoothing_and_threshold():
    assert html_main.smoothed([1.0, 1.0, 1.0]) == pytest.approx([1, 1, 1]) and 1 < html_main.threshold([0.0, 1.0, 1.0, 50.0, 60.0]) < 50


# op 6


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney by the book, over dictionaries."""
    from collections import Counter, defaultdict

    level = {order: Counter(int(k) for t in texts for g in kneser_ney.grams(t, order) for k in g)}
    for n in range(order - 1, 0, -1):
        level[n] = Counter(k & kneser_ney.mask(n) for k in level[n + 1])
    discount, total, lost = {}, defaultdict(int), defaultdict(float)
    for n, counts in level.items():
        cc = [sum(c == i for c in counts.values()) for i in range(5)]
        y = cc[1] / (cc[1] + 2 * cc[2]) if cc[1] + cc[2] else 0.5
        discount[n] = [0] + [max(min(i - (i + 1) * y * cc[i + 1] / max(cc[i], 1), i - 0.05), 0.05) for i in (1, 2, 3)]
        for k, c in counts.items():
            total[n, k >> kneser_ney.BITS] += c
            lost[n, k >> kneser_ney.BITS] += discount[n][min(c, 3)]

    def p(n, k):
        if n == 0:
            return 1 / kneser_ney.CLASSES
        k &= kneser_ney.mask(n)
        if (n, k >> kneser_ney.BITS) not in total:
            return p(n - 1, k)
        c = level[n].get(k, 0)
        return ((c - discount[n][min(c, 3)]) if c else 0) / total[n, k >> kneser_ney.BITS] + lost[n, k >> kneser_ney.BITS] / total[n, k >> kneser_ney.BITS] * p(n - 1, k)

    return p


@pytest.mark.parametrize("shard_rows", [1 << 30, 40])
def test_model_by_brute_force(spark, shard_rows):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc dя") for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = kneser_ney.saved(kneser_ney.estimate(kneser_ney.counts(df, 3, most=50), 3), 3, shard_rows)
    assert (len(model.numbers) > 1) == (shard_rows == 40)
    p = brute_model(texts, 3)
    levels = kneser_ney.levels_of(model)["en"]
    for text in [*texts[:3], "abcx!\né", "", "zzz", "𝔘я"]:
        want = sum(math.log(p(3, int(k))) for g in kneser_ney.grams(text, 3) for k in g)
        assert kneser_ney.score(levels, text) == pytest.approx(want, rel=1e-4, abs=1e-4)
    whole = [p(3, 5 << kneser_ney.BITS | 4 << 2 * kneser_ney.BITS | w) for w in range(kneser_ney.CLASSES)]
    assert sum(whole) == pytest.approx(1)


def test_classified_by_brute_force(spark):
    """Every column of the result, from models, means and quantiles that are worked out here."""
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice("abcd " if rnd.random() < 0.9 else "xyz") for _ in range(rnd.randrange(0, 80))), rnd.choice(["en", "de", None])) for i in range(240)]
    labels = [(i, int(rnd.random() < 0.8), int(rnd.random() < 0.1)) for i in range(0, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = {r["doc_id"]: r["h"] for r in docs.select("doc_id", kneser_ney.half(0).alias("h")).collect()}
    good = {i for i, quality, toxic in labels if quality == 1 and toxic == 0}
    got = {r["doc_id"]: r for r in kneser_ney.classified(docs, marks, order=3, quantile=0.9, shard_rows=50).collect()}
    assert len(got) == len(rows)
    for lang in ("en", "de", None):
        own = [(i, t) for i, t, x in rows if x == lang]
        p = brute_model([t for i, t in own if i in good and first[i]], 3)
        logp = {i: sum(math.log(p(3, int(k))) for g in kneser_ney.grams(t, 3) for k in g) for i, t in own}
        held = [(i, t) for i, t in own if i in good and not first[i]]
        mean = -sum(logp[i] for i, _ in held) / sum(len(t) for _, t in held)
        score = {i: (-logp[i] + kneser_ney.PRIOR * mean) / (len(t) + kneser_ney.PRIOR) for i, t in own}
        ranked = sorted(score[i] for i, _ in held)
        limit = ranked[math.ceil(0.9 * len(ranked)) - 1]
        for i, t in own:
            r = got[i]
            assert r["chars"] == len(t) and r["score"] == pytest.approx(score[i], rel=1e-4) and r["threshold"] == pytest.approx(limit, rel=1e-4)
            assert r["perplexity"] is None if not t else r["perplexity"] == pytest.approx(math.exp(-logp[i] / len(t)), rel=1e-3)
            assert r["keep"] == (not t or r["score"] <= r["threshold"])
    assert 0 < sum(not r["keep"] for r in got.values()) < 120


def test_long_texts_in_parts(monkeypatch):
    text = "the quick brown fox " * 50
    whole = np.concatenate(list(kneser_ney.grams(text)))
    monkeypatch.setattr(kneser_ney, "PART", 7)
    assert np.array_equal(whole, np.concatenate(list(kneser_ney.grams(text))))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    fresh = queries.op6_kneser_ney_quality(spark, sf).where(kneser_ney.half(1)).join(table(spark, sf, "labels"), "doc_id").toPandas()
    good, bad = fresh[fresh["quality"] == 1], fresh[fresh["quality"] == 0]
    assert good["keep"].mean() > 0.95 and (~bad["keep"]).mean() > 0.6


def test_op6_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (5, 1, None), (8, 1, 0), (None, 1, 0), (99, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert [r[0] for r in kneser_ney.trusted_ids(labels).where("doc_id is not null").orderBy("doc_id").collect()] == [1, 5, 8, 99]
    got = kneser_ney.classified(odd, labels).collect()
    assert len(got) == odd.count() and all(r["keep"] for r in got if not r["chars"])
    kept = kneser_ney.kept(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)
    clashing = odd.withColumns({"_chars": F.lit(1), "_logp": F.lit("x"), "_mean": F.lit(2), "_own": F.lit(None).cast("string"), "_threshold": F.lit(3), "__keep": F.lit(4)})
    assert kneser_ney.kept(clashing, labels).columns == clashing.columns and kneser_ney.kept(clashing, labels).count() == kept.count()
    empty = labels.where("false")
    assert kneser_ney.classified(none, labels).count() == 0 and all(r["keep"] for r in kneser_ney.classified(odd, empty).collect())


# op 9

CALL = '<tool_call>{"name": "search", "id": "%s", "arguments": %s}</tool_call>'


@pytest.fixture(scope="module")
def chats(spark):
    rows = [
        (1, 0, "user", "find it"),
        (1, 1, "tool", '{"tool_call_id": "late", "content": {"b": 1, "a": [2, 1]}}'),
        (1, 2, "assistant", "Looking." + CALL % ("late", '{"query": "x", "limit": 3}') + CALL % ("never", '{"limit": "3", "more": 1}')),
        (1, 3, "tool", '{"tool_call_id": "late", "content": "again"}'),
        (1, 4, "tool", '{"tool_call_id": "who", "content": "?"}'),
        (1, 5, "tool", "no json"),
        (1, 6, "assistant", "<tool_call>not json</tool_call><tool_call>{}</tool_call>" + CALL % ("late", "{}")),
        (2, 0, "assistant", CALL % ("late", '{"query": "y"}')), (2, 1, "tool", '{"tool_call_id": "late", "content": 1}'),
        (2, None, "user", None), (None, 0, None, 'quote " \\ \n é'), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 0, "assistant", '<tool_call>{"id": "i", "name": "nope", "arguments": {}}</tool_call>'), (3, 2, "tool", '{"tool_call_id": "i"}'),
    ]
    return spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id long, turn long, role string, text string, position int, json string")


def test_links_order_and_errors(chats):
    calls, results = chat.linked(chats)
    status = {(r["conv_id"], r["turn"], r["at"]): r["status"] for r in calls.drop("arguments").collect()}
    assert status == {(1, 2, 0): "linked", (1, 2, 1): "unanswered", (1, 6, 0): "malformed", (1, 6, 1): "malformed", (1, 6, 2): "duplicate", (2, 0, 0): "linked", (3, 0, 0): "linked"}
    assert {(r["conv_id"], r["turn"]): r["status"] for r in results.collect()} == {(1, 1): "linked", (1, 3): "duplicate", (1, 4): "orphan", (1, 5): "orphan", (2, 1): "linked", (3, 2): "linked"}
    errors = {(r["conv_id"], r["turn"], r["at"]): r["errors"] for r in chat.validated(calls, queries.TOOLS).collect()}
    assert errors[1, 2, 0] == [] and errors[1, 2, 1] == ["missing:query", "type:limit", "unknown:more"] and errors[1, 6, 2] == ["missing:query"] and errors[3, 0, 0] == ["tool:nope"]


def test_formatted(chats):
    rows = chat.formatted(chats, queries.TOOLS, block_turns=2).orderBy("conv_id", "position").collect()
    assert len(rows) == chats.count()
    one = [r for r in rows if r["conv_id"] == 1]
    assert [r["turn"] for r in one] == [0, 2, 1, 3, 4, 5, 6] and [r["position"] for r in one] == list(range(1, 8))
    assert one[1]["json"] == '{"calls":[{"arguments":{"limit":3,"query":"x"},"id":"late","name":"search"},{"arguments":{"limit":"3","more":1},"id":"never","name":"search"}],"content":"Looking.","role":"assistant"}'
    assert one[1]["n_calls"] == 2 and one[1]["n_bad"] == 1 and one[6]["n_bad"] == 3 and [r["link"] for r in one[2:6]] == ["linked", "duplicate", "orphan", "orphan"]
    assert json.loads(one[2]["json"]) == {"content": {"content": {"a": [2, 1], "b": 1}, "tool_call_id": "late"}, "role": "tool"}
    assert [r["turn"] for r in rows if r["conv_id"] == 2] == [0, 1, None] and [r["position"] for r in rows if r["conv_id"] == 3] == [1, 2, 3, 4]
    for r in rows:
        json.loads(r["json"])
    again = chat.formatted(chats, queries.TOOLS).orderBy("conv_id", "position").collect()
    assert list(map(str, again)) == list(map(str, rows))
    assert chat.formatted(chats.where("false"), queries.TOOLS).count() == 0


def test_messages_that_share_a_turn(spark):
    good, bad = CALL % ("g", '{"query": "x"}'), CALL % ("b", '{"limit": 1}')
    rows = [(1, 0, "assistant", good), (1, 0, "assistant", bad), (1, 0, "tool", '{"tool_call_id": "g", "content": 1}'), (1, 0, "tool", '{"tool_call_id": "g", "content": 2}'), (1, 0, "tool", '{"tool_call_id": "b"}')]
    got = {r["json"]: (r["n_calls"], r["n_bad"], r["link"]) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.TOOLS).collect()}
    assert sorted(v[:2] for v in got.values() if v[0]) == [(1, 0), (1, 1)] and sorted(str(v[2]) for v in got.values()) == ["None", "None", "duplicate", "linked", "linked"]


def brute_chats(rows, schemas):
    """Of each conversation, in order: turn, role, n_calls, n_bad, link."""
    import re

    kinds = {"string": str, "integer": int, "number": (int, float)}
    out = []
    for conv in {r[0] for r in rows}:
        place = lambda m: (m[1] is None, m[1] or 0, m[2] is None, m[2] or "", m[4])
        own = sorted((r for r in rows if r[0] == conv), key=place)
        heads, answers, calls_of, result_of = {}, {}, {}, {}
        for m in own:
            calls = []
            for raw in re.findall(r"<tool_call>(.*?)</tool_call>", m[3], re.S) if m[2] == "assistant" else []:
                try:
                    c = json.loads(raw)
                    calls.append(c if isinstance(c, dict) and c.get("id") is not None and c.get("name") is not None else None)
                except ValueError:
                    calls.append(None)
            calls_of[m[:4]] = calls
            for at, c in enumerate(calls):
                if c:
                    heads.setdefault(c["id"], (m[:4], at, m[1]))
            if m[2] == "tool":
                try:
                    c = json.loads(m[3])
                    result_of[m[:4]] = c.get("tool_call_id") if isinstance(c, dict) else None
                except ValueError:
                    result_of[m[:4]] = None
                if result_of[m[:4]] is not None:
                    answers.setdefault(result_of[m[:4]], m[:4])
        done = []
        for m in own:
            n_bad = 0
            for at, c in enumerate(calls_of[m[:4]]):
                ok = bool(c) and heads[c["id"]][:2] == (m[:4], at) and c["id"] in answers
                if ok:
                    schema, given = schemas.get(c["name"]), c.get("arguments")
                    given = given if isinstance(given, dict) else {}
                    ok = schema is not None and all(p in schema and isinstance(v, kinds[schema[p][0]]) for p, v in given.items()) and all(p in given for p, (_, need) in schema.items() if need)
                n_bad += not ok
            link, at = None, (m[1] is None, m[1] or 0, 0)
            if m[2] == "tool":
                i = result_of[m[:4]]
                link = "orphan" if i not in heads else "linked" if answers[i] == m[:4] else "duplicate"
                if link == "linked" and m[1] is not None and heads[i][2] is not None and heads[i][2] > m[1]:
                    at = (False, heads[i][2], 1)
            done.append((at, place(m), (conv, m[1], m[2], len(calls_of[m[:4]]), n_bad, link)))
        out += [(*row, k + 1) for k, (_, _, row) in enumerate(sorted(done, key=lambda d: d[:2]))]
    return out


def test_chats_by_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for conv in range(40):
        ids = [f"i{n}" for n in range(4)]
        for _ in range(rnd.randrange(1, 14)):
            turn = rnd.randrange(6)
            if rnd.random() < 0.45:
                calls = [CALL % (rnd.choice(ids), rnd.choice(['{"query": "x"}', '{"query": 1}', '{"query": "x", "limit": 2}', '{"limit": "2"}', "{}", "3"])) if rnd.random() < 0.85 else "<tool_call>[1</tool_call>" for _ in range(rnd.randrange(3))]
                rows.append((conv, turn, "assistant", f"say {rnd.random()} " + "".join(calls)))
            elif rnd.random() < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rnd.choice([*ids, "nobody"]), "content": rnd.random()}) if rnd.random() < 0.9 else f"no json {rnd.random()}"))
            else:
                rows.append((conv, turn, rnd.choice(["user", None]), f"hello {rnd.random()}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    keyed = [(r["conv_id"], r["turn"], r["role"], r["text"], r["hash"]) for r in chat.with_key(df).collect()]
    want = brute_chats(keyed, queries.TOOLS)
    for block in (2, 1024):
        got = chat.formatted(df, queries.TOOLS, block_turns=block).collect()
        assert sorted(map(str, want)) == sorted(str((r["conv_id"], r["turn"], r["role"], r["n_calls"], r["n_bad"], r["link"], r["position"])) for r in got)
    assert {w[5] for w in want} == {None, "linked", "duplicate", "orphan"} and any(w[3] and not w[4] for w in want)


# the pipeline


def test_pipeline(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    first, at, counts = docs, docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(at)
    quality, unique, mix, tokens = counts
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    judged = kneser_ney.classified(docs, table(spark, sf_dir, "labels"))
    assert ids(quality) == ids(judged.where("keep")) and quality.count() > 0.8 * docs.count()
    # near-duplicates, by all pairs of sets of shingles
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in quality.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(texts)
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                one, two = find(x), find(y)
                up[max(one, two)] = min(one, two)
    assert ids(unique) == sorted({find(d) for d in texts}) and len(ids(unique)) < len(texts)
    # the mix, by the SQL that ranks all quotients
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/1/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"select doc_id, taken from ({queries.OP7_SQL}) where taken > 0").fetchall()}
    got = mix.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want
    # the tokens, by the library
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    rows = []
    for r in mix.collect():
        own = library.encode(r["text"] or "", add_special_tokens=False).ids
        rows.append((r["doc_id"], len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, tokens.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(rows)


def test_pipeline_stages_on_odd_rows(spark, odd, none, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and out.count() <= 3 * df.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, df.select(names), str(tmp_path)).count() == df.count()


def test_importing_leaves_no_session():
    assert "palimpsest.llm.queries" in sys.modules
