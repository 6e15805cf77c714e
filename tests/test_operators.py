"""Reports, resolution, the queue, the service and the command line."""

import gzip
import json
import os
import stat
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import packing, queueing, report, resolve, walk
from palimpsest.plans.policy import Policy, Registry
from palimpsest.sources import objects as store
from palimpsest.streaming import service

LINE = "2026-06-12T09:00:00Z INFO user bob@acme.test from 10.1.2.3 org=AcmeCorp\n"
TERMS = '{"literals": [{"value": "AcmeCorp", "replacement": "[COMPANY]"}], "presets": ["email", "ipv4"]}'
PNG = b"\x89PNG\r\n\x1a\n\0\1\2"


@pytest.fixture(scope="module")
def done(spark):
    bundle = packing.packed([("a.log", LINE.encode() * 3), ("b.txt", b"clean"), ("c.png", PNG), ("d.bin", b"7z\xbc\xaf\x27\x1c" + LINE.encode())], ["tar", "gzip"])
    rows = spark.createDataFrame([("x/one.tgz", bytearray(bundle)), ("two.log", bytearray(LINE.encode())), ("three.png", bytearray(PNG)), ("empty", bytearray())], "object_key string, content binary")
    return walk.walked(rows, {"p": Policy.parse(TERMS)}, "p").cache()


def test_summary(done):
    s = {r["object_key"]: r for r in report.summary(walk.files(done)).collect()}
    one = s["x/one.tgz"]
    assert (one["files_total"], one["files_scrubbed"], one["files_unchanged"], one["files_binary_skipped"], one["files_passthrough"], one["files_not_inspected"]) == (4, 1, 1, 1, 1, 2)
    assert one["matches_by_label"] == {"[COMPANY]": 3, "[EMAIL]": 3, "[IPV4]": 3} and one["by_reason"] == {"binary": 1, "unsupported-format": 1}
    assert {k: r["verdict"] for k, r in s.items()} == {"x/one.tgz": "incomplete-risky", "two.log": "complete", "three.png": "incomplete", "empty": "complete"}
    assert [n["path"] for n in one["not_inspected"]] == ["x/one.tgz!c.png", "x/one.tgz!d.bin"] and one["residual_hits"] == 3
    for r in s.values():
        assert r["files_inspected"] + r["files_not_inspected"] == r["files_total"] == r["files_scrubbed"] + r["files_unchanged"] + r["files_binary_skipped"] + r["files_passthrough"]


def test_report_levels(done):
    files, summaries = walk.files(done), report.summary(walk.files(done))
    full = {r["object_key"]: json.loads(r["report"]) for r in report.report_json(files, summaries).collect()}
    counts = {r["object_key"]: json.loads(r["report"]) for r in report.report_json(files, summaries, "counts").collect()}
    off = {r["object_key"]: json.loads(r["report"]) for r in report.report_json(files, summaries, "off").collect()}
    hashed = {r["object_key"]: json.loads(r["report"]) for r in report.report_json(files, summaries, "full", "salt").collect()}
    assert full["two.log"]["files"][0]["matches"][0]["original"] == "bob@acme.test"
    assert set(counts["two.log"]["files"][0]["matches"][0]) == {"rule", "line", "offset"}
    assert off["two.log"]["files"][0]["matches"] == [] and off["two.log"]["summary"]["total_matches"] == 3
    assert hashed["two.log"]["files"][0]["matches"][0]["original"].startswith("sha256:")
    with pytest.raises(ValueError):
        report.audited(F.col("matches"), F.col("kept"), "some")


def test_caps(spark):
    rows = [("o", i, 700) for i in range(40)]
    files = spark.createDataFrame(rows, "object_key string, seq int, match_count long")
    got = report.capped(files).orderBy("seq").collect()
    assert sum(r["kept"] for r in got) == report.REPORT_MATCHES and got[27]["kept"] == 700 and got[28]["kept"] == 400 and not got[0]["matches_truncated"] and got[28]["matches_truncated"]
    one = spark.createDataFrame([("o", 0, 3000)], "object_key string, seq int, match_count long")
    assert report.capped(one).first()["kept"] == 1000
    off = report.capped(one, audit="off").first()
    assert off["kept"] == 0 and not off["matches_truncated"]


def test_banner(done):
    lines = {r["object_key"]: r["banner"] for r in report.banner(report.summary(walk.files(done))).collect()}
    assert lines["two.log"] == "COMPLETE: all 1 file(s) inspected"
    assert "2 of 4" in lines["x/one.tgz"] and "binary=1" in lines["x/one.tgz"]


def test_one_bad_object_does_not_stop_the_others(spark):
    rows = spark.createDataFrame([("a", bytearray(LINE.encode()), "{"), ("b", bytearray(LINE.encode()), None), (None, None, None)], "object_key string, content binary, own string")
    got = {r["object_key"]: r for r in walk.walked(rows, {"p": Policy.parse(TERMS)}, "p", own_policy=F.col("own")).collect()}
    assert got["a"]["error"] and not got["a"]["changed"] and got["a"]["files"][0]["status"] == "passthrough-error"
    assert got["b"]["changed"] and got[None]["files"][0]["status"] == "unchanged"


def test_resolution(spark):
    rows = spark.createDataFrame([("secure/app.log", "1"), ("x.log", "2"), ("x.log.terms.json", "{}"), ("secure/sub/a", "3")], "object_key string, content string")
    got = {r["object_key"]: (r["own_policy"], r["policy"]) for r in resolve.with_sidecars(rows).withColumn("policy", resolve.longest_prefix(F.col("object_key"), {"secure/": "strict", "secure/sub/": "more"}, "default")).collect()}
    assert got == {"secure/app.log": (None, "strict"), "x.log": ("{}", "default"), "secure/sub/a": (None, "more")}
    empty = spark.createDataFrame([], "prefix string, policy string")
    assert {r["policy"] for r in resolve.by_prefix(rows, empty, "default").collect()} == {"default"}


def test_queue(spark):
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    q = spark.createDataFrame([("zzz", t(0)), ("aaa", t(2)), ("mmm", t(1)), ("c", t(5)), ("a", t(5)), ("b", t(5))], "object_key string, at timestamp")
    assert [r["object_key"] for r in queueing.ranked(q, buckets=2).orderBy("place").collect()] == ["zzz", "mmm", "aaa", "a", "b", "c"]
    running = q.where("object_key = 'zzz'")
    got = {r["object_key"]: (r["position"], r["depth"]) for r in queueing.positions(queueing.without_inflight(q, running), running).collect()}
    assert got["zzz"] == (1, 6) and got["mmm"] == (2, 6) and got["c"] == (6, 6)
    kept, dropped = queueing.synced(q, 4)
    assert [r["object_key"] for r in kept.collect()] == ["zzz", "mmm", "aaa", "a"] and dropped.first()["dropped"] == 2
    assert queueing.ranked(q.where("false")).count() == 0
    assert [r[0] for r in queueing.snapshot(q, 2).select("object_key").collect()] == ["zzz", "mmm"]
    running = spark.createDataFrame([("y",), ("x",)], "object_key string")
    assert [tuple(r) for r in queueing.snapshot(q, 1, running).select("object_key", "running").collect()] == [("x", True), ("y", True), ("zzz", False)]


def test_histogram(spark):
    got = queueing.histogram(spark.createDataFrame([(0.5,), (1.0,), (3.0,), (None,)], "v double"), "v", [1.0, 2.0]).collect()
    assert [(r["le"], r["n"]) for r in got] == [(1.0, 2), (2.0, 2), (float("inf"), 3)]


def test_service(spark, tmp_path):
    box = tmp_path / "in"
    (box / "secure").mkdir(parents=True)
    (box / "app.log").write_text(LINE)
    (box / "lux.txt").write_bytes((LINE * 4).encode("utf-32-le") + b"\0\0\x11\0")
    (box / "x.log").write_text(LINE + "zzz-secret")
    (box / "x.log.terms.json").write_text('{"literals": [{"value": "zzz-secret"}]}')
    (box / "secure" / "s.log").write_text("call (415) 555-2671")
    (box / "gone.log").write_text(LINE)
    registry = Registry({"default": Policy.parse(TERMS), "phones": Policy.presets("phone_us")}, "default", {"secure/": "phones"})
    s = service.Service(f"file://{box}", f"file://{tmp_path}/out", f"file://{tmp_path}/reports", f"file://{tmp_path}/check", registry, cancelled={"gone.log"})
    s.start(spark, per_trigger=2, interval=None).awaitTermination(120)
    out = tmp_path / "out"
    assert (out / "app.log").read_text() == LINE.replace("bob@acme.test", "[EMAIL]").replace("10.1.2.3", "[IPV4]").replace("AcmeCorp", "[COMPANY]")
    assert (out / "review" / "lux.txt").exists() and not (out / "lux.txt").exists() and not (out / "gone.log").exists()
    assert (out / "x.log").read_text() == LINE + "[REDACTED]"
    assert (out / "secure" / "s.log").read_text() == "call ([PHONE]"
    history = store.summaries(spark, f"file://{tmp_path}/reports")
    assert {r["object_key"]: r["verdict"] for r in history.collect()} == {"app.log": "complete", "lux.txt": "incomplete-risky", "x.log": "complete", "secure/s.log": "complete"}
    assert store.full_reports(spark, f"file://{tmp_path}/reports").count() == 4
    assert len(s.token("k", b"s")) == 32 and s.reload() is None
    assert s.cancel(spark, "app.log") == "too-late" and s.cancel(spark, "gone.log") == "withdrawn" and s.cancel(spark, "no") == "not-found"


def test_failed_objects_are_tried_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text(LINE)
    (tmp_path / "in" / "x.log.terms.json").write_text("{")
    s = service.Service(f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/reports", f"file://{tmp_path}/check", Registry({"default": Policy.parse(TERMS)}, "default"))
    s.start(spark, per_trigger=5, interval=None).awaitTermination(120)
    assert s.deferred["x.log"][0] == 1 and not (tmp_path / "out" / "x.log").exists()
    assert s.again(spark, now=0) == 0
    (tmp_path / "in" / "x.log.terms.json").write_text(TERMS)
    assert s.again(spark, now=1e12) == 1 and not s.deferred
    assert "[EMAIL]" in (tmp_path / "out" / "x.log").read_text()


def test_too_large_is_reported_and_put_away(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "huge.log").write_text("x" * 1024)
    (tmp_path / "in" / "app.log").write_text(LINE)
    s = service.Service(f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/reports", f"file://{tmp_path}/check", Registry({"default": Policy.parse(TERMS)}, "default"), most_bytes=256, done=f"file://{tmp_path}/done")
    s.start(spark, per_trigger=5, interval=None).awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "done" / "processed").iterdir()) == ["app.log", "huge.log"] and not list((tmp_path / "in").iterdir())
    assert (tmp_path / "out" / "app.log").exists() and not (tmp_path / "out" / "huge.log").exists()
    found = {r["object_key"]: (r["verdict"], r["files_not_inspected"], r["by_reason"]) for r in store.summaries(spark, f"file://{tmp_path}/reports").collect()}
    assert found == {"app.log": ("complete", 0, {}), "huge.log": ("incomplete", 1, {"expansion-budget": 1})}


def test_cancels_and_tries_outlive_the_driver(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("bad.log", "gone.log", "good.log"):
        (tmp_path / "in" / name).write_text(LINE)
    (tmp_path / "in" / "bad.log.terms.json").write_text("{")
    args = [f"file://{tmp_path}/{x}" for x in ("in", "out", "reports", "check")]
    registry = Registry({"default": Policy.parse(TERMS)}, "default")
    first = service.Service(*args, registry, done=f"file://{tmp_path}/done")
    assert first.cancel(spark, "gone.log") == "withdrawn" and (tmp_path / "done" / "cancelled" / "gone.log").exists()
    first.start(spark, per_trigger=5, interval=None).awaitTermination(120)
    assert first.cancel(spark, "good.log") == "too-late" and (tmp_path / "done" / "processed" / "good.log").exists()
    second = service.Service(*args, registry, done=f"file://{tmp_path}/done", delete=True)
    assert second.cancelled == {"gone.log"} and second.deferred["bad.log"][0] == 1
    (tmp_path / "in" / "bad.log.terms.json").unlink()
    assert second.again(spark, now=1e12) == 1 and "[EMAIL]" in (tmp_path / "out" / "bad.log").read_text()
    assert not (tmp_path / "in" / "bad.log").exists() and not service.Service(*args, registry).deferred
    assert not (tmp_path / "out" / "gone.log").exists()


def test_a_mark_aborts_the_walk(spark, tmp_path):
    marks = store.Marks(f"file://{tmp_path}/marks")
    marks.put("a", {})
    rows = spark.createDataFrame([("a", bytearray(LINE.encode())), ("b", bytearray(LINE.encode()))], "object_key string, content binary")
    got = {r["object_key"]: r for r in walk.walked(rows, {"p": Policy.parse(TERMS)}, "p", marks=marks.folder).collect()}
    assert got["a"]["error"] == walk.ABORTED and not got["a"]["files"] and not got["a"]["changed"] and got["b"]["changed"]
    service_ = service.Service(f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/r", f"file://{tmp_path}/c", Registry({"default": Policy.parse(TERMS)}, "default"))
    service_.running = {"a"}
    assert service_.cancel(spark, "a") == "aborting"
    digests = service.process(rows.withColumn("own_policy", F.lit(None).cast("string")), service_)
    assert [r["object_key"] for r in store.summaries(spark, f"file://{tmp_path}/r").collect()] == ["b"] and digests is not None


def test_throughput(spark):
    jobs = spark.createDataFrame([(datetime(2026, 1, 1, 0, 0, 5), "complete", 3), (datetime(2026, 1, 1, 0, 0, 50), "complete", 4)], "timestamp timestamp, verdict string, bytes_in long")
    r = service.throughput(jobs).first()
    assert (r["jobs"], r["bytes_in"]) == (2, 7)


def test_bounded_read(spark, tmp_path):
    (tmp_path / "a").write_text("x" * 10)
    (tmp_path / "b").write_text("x" * 99)
    small, large = store.objects(spark, str(tmp_path), 50)
    assert [r["object_key"] for r in small.select("object_key").collect()] == ["a"] and [r["object_key"] for r in large.collect()] == ["b"]
    assert store.exists(small, "a") and not store.exists(small, "b")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text(LINE)
    (tmp_path / "in" / "sub" / "b.gz").write_bytes(gzip.compress(LINE.encode()))
    (tmp_path / "terms.json").write_text(TERMS)
    return tmp_path


def test_cli(spark, folder, capsys):
    base = ["--terms", str(folder / "terms.json"), "--in", str(folder / "in")]
    assert cli.main([*base, "--out", str(folder / "out"), "--report", str(folder / "r.json"), "--verbose"]) == 0
    assert "[EMAIL]" in (folder / "out" / "a.log").read_text() and b"[EMAIL]" in gzip.decompress((folder / "out" / "sub" / "b.gz").read_bytes())
    rep = json.loads((folder / "r.json").read_text())
    assert rep["summary"]["total_matches"] == 6 and len(rep["files"]) == 2
    assert stat.S_IMODE(os.stat(folder / "r.json").st_mode) == 0o600
    assert "COMPLETE" in capsys.readouterr().err and rep["summary"]["residual_samples"] == []
    (folder / "in" / "c.png").write_bytes(PNG)
    assert cli.main([*base, "--dry-run", "--fail-on-unscrubbed"]) == 3
    assert cli.main([*base, "--dry-run", "--fail-on-risky"]) == 0
    one = ["--terms", str(folder / "terms.json"), "--in", str(folder / "in" / "a.log")]
    os.chmod(folder / "in" / "a.log", 0o640)
    assert cli.main([*one, "--in-place"]) == 0 and "[EMAIL]" in (folder / "in" / "a.log").read_text()
    assert stat.S_IMODE(os.stat(folder / "in" / "a.log").st_mode) == 0o640


def test_samples_of_a_report(spark):
    head = bytearray(b"7z\xbc\xaf\x27\x1c\0\0" + LINE.encode())
    rows = spark.createDataFrame([("o", packing.archived("tar", [(f"m{i:02}", bytes(head)) for i in range(30)])), ("p", LINE.encode())], "object_key string, content binary")
    done = walk.walked(rows, {"p": Policy.parse(TERMS)}, "p")
    files = walk.files(done)
    for found in (walk.samples(done), report.samples_of(files)):
        got = {r["object_key"]: r for r in report.with_samples(report.summary(files), found).collect()}
        assert got["p"]["residual_samples"] == [] and got["o"]["files_not_inspected"] == 30 and got["o"]["residual_hits"] > 0
        assert [x.split(" ")[0] for x in got["o"]["residual_samples"]] == [f"o!m{i:02}" for i in range(report.SAMPLES)]


def test_unreadable_files_are_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"file:{tmp_path}/a"), ("b", f"file:{tmp_path}/none")], "object_key string, path string")
    (tmp_path / "a").write_text(LINE)
    got = {r["object_key"]: r for r in walk.walked(store.contents(rows), {"p": Policy.parse(TERMS)}, "p").collect()}
    assert got["a"]["changed"] and got["b"]["error"].startswith("OSError: No such file")
    assert [(f["status"], f["reason"]) for f in got["b"]["files"]] == [("passthrough-error", "unclassified")]


def test_caps_in_blocks(spark):
    files = spark.createDataFrame([("o", i, 7) for i in range(50)] + [("p", 3, 2)], "object_key string, seq int, match_count long")
    for block in (4, 4096):
        got = {(r["object_key"], r["seq"]): r["kept"] for r in report.capped(files, 5, 42, block=block).collect()}
        assert [got["o", i] for i in range(10)] == [5] * 8 + [2, 0] and got["p", 3] == 2


def test_bundles_are_bounded(spark):
    rows = spark.createDataFrame([("s" if i % 3 else None, i, "x" * 10) for i in range(300)], "source string, doc_id int, text string")
    made = packing.bundled(rows, "source", "doc_id", "text", ("tar",), most_rows=20)
    assert made.count() > 10 and packing.unbundled(made, "content").count() == 300


def test_leaves_that_begin_like_containers(spark):
    texts = ["80 sheep", "x rays", "PK\x03\x04 no zip", "plain"]
    rows = spark.createDataFrame([("o", packing.archived("tar", [("m", t.encode()) for t in texts]))], "object_key string, content binary")
    done = walk.walked(rows, {"p": Policy.parse(TERMS)}, "p")
    assert [r["text"] for r in packing.unbundled(done).collect()] == texts
    assert [(r["text"], r["n_matches"]) for r in packing.unbundled(done, counted=True).collect()] == [(t, 0) for t in texts]


def test_cli_errors(spark, folder):
    assert cli.main([]) == 2
    assert cli.main(["--terms", str(folder / "terms.json"), "--in", str(folder / "in")]) == 2
    assert cli.main(["--terms", str(folder / "nope.json"), "--in", str(folder), "--dry-run"]) == 2
    assert cli.main(["--terms", str(folder / "terms.json"), "--in", str(folder / "nope"), "--dry-run"]) == 1
    assert cli.main(["--nonsense"]) == 2
