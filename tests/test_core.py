"""Policies, matching, encodings, containers and the walk."""

import gzip
import io
import lzma
import random
import tarfile
import zipfile
import zlib

import pytest
import zstandard

from palimpsest.functions import containers, encodings, formats, residual
from palimpsest.functions.matching import Matcher
from palimpsest.functions.validators import luhn, register
from palimpsest.operators.walk import REASONS, STATUSES, Limits, Walk
from palimpsest.plans import regex
from palimpsest.plans.policy import Policy, PolicyError, Registry, Rule, parse_prefixes

LINE = "2026-06-12T09:00:00Z INFO user bob@acme.test from 10.1.2.3 org=AcmeCorp\n"
CLEAN = "nothing sensitive on this line at all\n" * 8
TERMS = Policy.parse('{"literals": [{"value": "AcmeCorp", "replacement": "[COMPANY]"}], "presets": ["email", "ipv4"]}')


def scrub(policy, text):
    return Matcher(policy).scrub(text)


@pytest.mark.parametrize(
    ("rules", "text", "want"),
    [
        ([("a", "secret", ""), ("b", r"tok-\d+", "[TOK]")], "a secret and tok-42 here", "a [REDACTED] and [TOK] here"),
        ([("a", r"\bhunter2\b", "[A]"), ("b", "hunter2", "[B]")], "xhunter2x", "x[A]x"),
        ([("a", "ab|abc", "[A]"), ("b", "abc", "[B]")], "abc", "[A]c"),
        ([("a", "(?i)KELVIN", "[A]")], "Kelvin", "[A]"),
        ([("a", r"\d{2}", "$1")], "é12é", "é$1é"),
        ([("a", r"a.b", "[A]")], "a\rb a\nb", "[A] a\nb"),
        ([("a", r"x$", "[A]")], "x\nx", "x\n[A]"),
        ([("a", r"(?m)^-", "[A]")], "-\n-", "[A]\n[A]"),
        ([("a", r"[[:digit:]]+[^\D5]", "[A]")], "124 125", "[A] [A]5"),
        ([("a", r"\Qa.b\E+", "[A]")], "a.bb axb", "[A] axb"),
    ],
)
def test_matching(rules, text, want):
    assert scrub(Policy.of([Rule(f"regex:{i}", p, r) for i, p, r in rules]), text)[0] == want


def test_empty_matches():
    p = Policy.of([Rule("regex:blank", r"(?m)^$", "[EMPTY]")])
    assert p.may_match_empty
    assert scrub(p, "a\n\nb")[0] == "a\n[EMPTY]\nb"


def test_rejected_span_is_consumed():
    p = Policy.presets("credit_card", "phone_us")
    assert scrub(p, "1234567890123456") == ("1234567890123456", [])


def test_records_count_bytes_and_lines():
    m = scrub(TERMS, "é\nx bob@acme.test\n10.1.2.3")[1]
    assert [(x.rule, x.line, x.offset) for x in m] == [("preset:email", 2, 5), ("preset:ipv4", 3, 19)]


@pytest.mark.parametrize(
    ("preset", "text", "want"),
    [
        ("windows_account", r"login ACME\jsmith and CORP\svc_backup$ ok", "login [ACCOUNT] and [ACCOUNT] ok"),
        ("upn", "user jsmith@acme.com signed in", "user [UPN] signed in"),
        ("fqdn", "host db-prod-01.internal.acme.com served file archive.tar.gz", "host [FQDN] served file archive.tar.gz"),
        ("hostname", "server db-prod-01 had an error during login", "server [HOST] had an error during login"),
        ("ssn", "é123-45-6789é", "é[SSN]é"),
        ("credit_card", "4111 1111 1111 1111 or 1234 5678 9012 3456", "[CARD] or 1234 5678 9012 3456"),
    ],
)
def test_presets(preset, text, want):
    assert scrub(Policy.presets(preset), text)[0] == want


def test_luhn_bounds():
    assert luhn("4111 1111 1111 1111") and not luhn("1234 5678 9012 3456") and not luhn("0" * 12) and luhn("0" * 13) and not luhn("0" * 20)


def test_own_validator():
    register("even", lambda s: len(s) % 2 == 0, None)
    assert scrub(Policy.of([Rule("regex:d", r"\d+", "[D]", "even")]), "12 vs 123")[0] == "[D] vs 123"


@pytest.mark.parametrize("raw", ["{", '{"regex": [{"pattern": "("}]}', '{"presets": ["nope"]}', "{}", '{"literals": [{"value": ""}]}', '{"x": 1}', '{"regex": [{"pattern": "(?=a)"}]}', '{"regex": [{"pattern": "a{1001}"}]}', '{"regex": [{"pattern": "a++"}]}', '{"regex": [{"pattern": "(a)\\\\1"}]}', '{"regex": [{"pattern": "x*"}]}'])
def test_bad_policies(raw):
    with pytest.raises(PolicyError):
        Policy.parse(raw)


@pytest.mark.parametrize("rules", [[("secret", "secret-[REDACTED]")], [("Acme", "[COMPANY]"), ("COMPANY", "[X]")], [("REDACTED", "")]])
def test_policies_that_do_not_converge(rules):
    with pytest.raises(PolicyError):
        Policy.of([Rule(f"regex:{p}", p, r) for p, r in rules])


def test_accepted_policies():
    assert Policy.parse('{"Presets": ["email"]} trailing').rules[0].id == "preset:email"
    Policy.of([Rule("regex:n", r"\d{16}", "4111111111111112", "luhn")])


def test_registry(tmp_path):
    (tmp_path / "default.json").write_text('{"literals": [{"value": "AcmeCorp"}]}')
    (tmp_path / "strict.json").write_text('{"presets": ["email", "ipv4"]}')
    r = Registry.load(str(tmp_path), prefixes=parse_prefixes('{"secure/": "strict", "sec": "default"}'))
    assert [r.name_for(k) for k in ("secure/app.log", "logs/app.log", "second")] == ["strict", "default", "default"]
    assert r.name_for("x", "strict") == "strict" and r.names() == ["default", "strict"]
    (tmp_path / "strict.json").write_text("{")
    with pytest.raises(PolicyError):
        r.reload(str(tmp_path))
    assert r.policies["strict"].rules[0].id == "preset:email"


def test_names():
    m = Matcher(TERMS)
    assert m.scrub_name("logs/../AcmeCorp/a@b.co")[0] == "logs/../[COMPANY]/[EMAIL]"
    assert Matcher(Policy.of([Rule("regex:x", "x", "a/b\\c")])).scrub_name("q/x")[0] == "q/a_b_c"
    assert m.scrub_name("a/b") == ("a/b", [])


def test_needed_characters_never_hide_a_match():
    rnd, p = random.Random(7), Policy.presets("email", "ipv4", "ipv6", "credit_card", "ssn", "aws_key", "jwt", "phone_us")
    m = Matcher(p)
    for _ in range(3000):
        text = "".join(rnd.choice([*"abe1924.:-@ +(AKI", "AKIA", "eyJa.", "10.0.0.1", "a@b.co"]) for _ in range(rnd.randrange(40)))
        assert bool(m.combined.search(text)) <= bool(m.needed.search(text))


def test_java_and_python_forms_are_written():
    for pattern in (r"\b\w+\b", r"[^a-c]\S$", r"(?s).", r"(?i:é)[[:^alpha:]]", r"\x{1F600}"):
        assert regex.for_java(pattern) and regex.for_python(pattern)


# encodings


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le", "utf-16-be", "utf-16", "utf-32-le", "utf-32-be", "utf-32", "utf-8-sig"])
def test_encodings_round_trip(codec):
    data = (LINE * 4).encode(codec)
    name = encodings.sniff(data)
    text, refused = encodings.decode(data, name)
    assert refused is None and encodings.encode(text, name) == data
    assert "bob@acme.test" in text


def test_bytes_round_trip():
    rnd = random.Random(3)
    for _ in range(500):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(64)))
        for name in ("utf-8", "utf-16le", "utf-16be", "utf-32le", "utf-32be"):
            text, refused = encodings.decode(data, name)
            assert refused or encodings.encode(text, name) == data


def test_binary():
    assert encodings.sniff(b"a\0b") == "binary" and encodings.sniff(b"") == "utf-8" and encodings.sniff(b"caf\xe9 au lait") == "utf-8"
    assert encodings.sniff("é".encode()[:1]) == "utf-8" and encodings.sniff(b"\xff\x01\x02\x03\x04") == "binary"


# formats


def tar_of(*members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode, info.uname = len(body), 1_700_000_000, 0o640, "ops"
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def zip_of(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, body) in enumerate(members):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), body, zipfile.ZIP_DEFLATED if i % 2 == 0 else zipfile.ZIP_STORED)
    return out.getvalue()


PACK = {"gzip": lambda b: gzip.compress(b, mtime=5), "zlib": zlib.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress, "tar": lambda b: tar_of(("m.log", b)), "zip": lambda b: zip_of(("m.log", b))}


def test_detect():
    for name, f in PACK.items():
        assert formats.detect(f(LINE.encode())[:512]) == name
    for text in (b"BZhang, Wei", b"", b"plain", b"BZh"):
        assert formats.detect(text) == ""
    assert formats.detect(b"BZh9text") == "bzip2" and formats.detect(b"x \n") == "" or formats.is_zlib(b"x ")


def walked(data, **limits):
    w = Walk(Matcher(TERMS), Limits(**limits))
    out, changed = w.run("o", data)
    return w, out, changed


def corpus():
    raw, text = (LINE * 4).encode(), LINE * 4
    yield from [("utf-8", raw, {}, "scrubbed", None, False), ("mark", b"\xef\xbb\xbf" + raw, {}, "scrubbed", None, False), ("latin-1", b"caf\xe9 " + raw, {}, "scrubbed", None, False), ("clean", CLEAN.encode(), {}, "unchanged", None, False)]
    for codec in ("utf-16-le", "utf-16-be", "utf-16", "utf-32-le", "utf-32-be", "utf-32"):
        yield codec, text.encode(codec), {}, "scrubbed", None, False
    yield "bad utf-32", text.encode("utf-32-le") + b"\0\0\x11\0", {}, "binary-skipped", "encoding-unsupported", True
    yield "bad utf-16", text.encode("utf-16-le") + b"\0\xd8", {}, "binary-skipped", "encoding-unsupported", True
    yield "png", b"\x89PNG\r\n\x1a\n" + bytes([1, 2, 3, 0x7F]) * 400, {}, "binary-skipped", "binary", False
    for name, f in PACK.items():
        yield name, f(raw), {}, "scrubbed", None, False
    yield "tar.gz", gzip.compress(tar_of(("m.log", raw))), {}, "scrubbed", None, False
    yield "tar.gz of utf-16", gzip.compress(tar_of(("m.log", text.encode("utf-16")))), {}, "scrubbed", None, False
    for head in (b"BZh9", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07\x00"):
        yield repr(head), head + raw, {}, "unsupported-format", "unsupported-format", True
    for head in (b"x ", b"H,", b"h$", b"BZhang, Wei "):
        yield repr(head), head + raw, {}, "scrubbed", None, False
    yield "budget", gzip.compress(tar_of(("m.log", raw))), {"total_bytes": 64}, "guard-tripped", "expansion-budget", False
    yield "members", tar_of(*[(f"m{i}.log", raw) for i in range(6)]), {"members": 2}, "guard-tripped", "member-cap", True
    yield "depth", gzip.compress(raw, compresslevel=0), {"depth": 0}, "guard-tripped", "depth-cap", True
    yield "cut gzip", gzip.compress(raw)[: len(gzip.compress(raw)) // 2], {}, "passthrough-error", "malformed", False


@pytest.mark.parametrize(("name", "data", "limits", "status", "reason", "risky"), list(corpus()))
def test_corpus(name, data, limits, status, reason, risky):
    w, out, changed = walked(data, **limits)
    e = w.entries[-1]
    assert (e.status, e.reason) == (status, reason) and e.status in STATUSES and (reason is None or reason in REASONS)
    if status == "guard-tripped" and reason == "depth-cap":
        assert e.path == "o"
    if risky:
        assert e.residual_hits and e.residual
    if status != "scrubbed":
        assert out == data and not changed
    else:
        again, _, more = walked(out)
        assert not more and all(x.status != "scrubbed" for x in again.entries)


def test_nested_bundle():
    deep = gzip.compress(zip_of(("mid.zip", zip_of(("inner.tar.gz", gzip.compress(tar_of(("deep.log.gz", gzip.compress(LINE.encode())))))))))
    w, out, changed = walked(deep)
    assert changed and [e.path for e in w.entries] == ["o!mid.zip!inner.tar.gz!deep.log.gz"] and len(w.entries[0].matches) == 3


def test_mixed_bundle_and_names():
    bundle = gzip.compress(tar_of(("logs/AcmeCorp.log", LINE.encode()), ("logs/image.png", b"\x89PNG\r\n\x1a\n\0\1"), ("logs/broken.zip", b"PK\x03\x04totally not a real zip body"), ("logs/n.zip", zip_of(("inner/app2.log", LINE.encode())))))
    w, out, _ = walked(bundle)
    assert [(e.path, e.status) for e in w.entries] == [
        ("o!logs/AcmeCorp.log [name]", "scrubbed"), ("o!logs/AcmeCorp.log", "scrubbed"), ("o!logs/image.png", "binary-skipped"), ("o!logs/broken.zip", "passthrough-error"), ("o!logs/n.zip!inner/app2.log", "scrubbed"),
    ]
    names = [m.name for m in containers.read_tar(gzip.decompress(out), 1 << 30, 100)]
    assert names == ["logs/[COMPANY].log", "logs/image.png", "logs/broken.zip", "logs/n.zip"]


def test_headers_stay():
    src = io.BytesIO()
    with gzip.GzipFile("app.log", "wb", fileobj=src, mtime=1234) as f:
        f.write(LINE.encode())
    _, out, _ = walked(src.getvalue())
    head = containers.gzip_header(out)
    assert (head.name, head.mtime) == (b"app.log", 1234)
    _, out, _ = walked(tar_of(("a.log", LINE.encode())))
    info = containers.read_tar(out, 1 << 30, 9)[0].header
    assert (info.mtime, info.mode, info.uname) == (1_700_000_000, 0o640, "ops")
    _, out, _ = walked(zip_of(("a.log", LINE.encode()), ("b.log", LINE.encode())))
    infos = zipfile.ZipFile(io.BytesIO(out)).infolist()
    assert [i.compress_type for i in infos] == [8, 0] and infos[0].date_time == (2024, 1, 2, 3, 4, 6)


def test_clean_bundles_stay_as_they_are():
    data = gzip.compress(tar_of(("a", CLEAN.encode()), ("z.zip", zip_of(("b", CLEAN.encode())))), compresslevel=3)
    w, out, changed = walked(data)
    assert out is data and not changed and len(w.entries) == 2


def test_many_gzip_members():
    w, out, changed = walked(gzip.compress(LINE.encode()) + gzip.compress(CLEAN.encode()))
    assert changed and gzip.decompress(out).decode().endswith(CLEAN)


def test_failed_repack_takes_all_back(monkeypatch):
    def broken(members, data):
        raise OSError("disk")

    monkeypatch.setattr(containers, "write_tar", broken)
    data = tar_of(("a.log", LINE.encode()), ("b.log", LINE.encode()))
    w, out, changed = walked(data)
    assert out == data and not changed
    assert [(e.status, e.reason, len(e.matches), e.residual_hits > 0) for e in w.entries] == [("passthrough-error", "repack-failed", 0, True)]


def test_abort_returns_the_input():
    calls = iter([False, False, True, True, True, True, True])
    data = tar_of(("a.log", LINE.encode()), ("b.log", LINE.encode()))
    w = Walk(Matcher(TERMS), aborted=lambda: next(calls, True))
    assert w.run("o", data) == (data, False)


def test_verify():
    p = Policy.of([Rule("regex:a", "ab", "x")])
    m = Matcher(p)
    w = Walk(m, Limits(verify=True))
    out, changed = w.run("o", b"aabb aab")
    assert not changed or b"ab" not in out
    bad = Walk(Matcher(Policy((Rule("regex:a", "ab", "ab"),))), Limits(verify=True))
    assert bad.run("o", b"xab")[1] is False and bad.entries[0].status == "residual-match"


def test_residual_budget_and_order():
    m = Matcher(TERMS)
    r = residual.scan((LINE * 2000).encode(), m, 1000)
    assert r.truncated and r.summary().endswith("(partial scan)") and r.summary().index("[COMPANY]") < r.summary().index("[EMAIL]")
    assert residual.scan(LINE.encode("utf-16-be"), m, 1 << 20).hits and residual.scan(b"\x89PNG\r\n\x1a\n" + bytes(range(1, 30)) * 99, m, 1 << 20).hits == 0


def test_budgets_run_over_members():
    big = gzip.compress(CLEAN.encode() * 2000)
    w, _, _ = walked(tar_of(*[(f"{i}.gz", big) for i in range(4)]), total_bytes=1 << 20)
    assert [e.reason for e in w.entries] == [None, "expansion-budget", "expansion-budget", "expansion-budget"]
    w, _, _ = walked(gzip.compress(gzip.compress(gzip.compress(gzip.compress(LINE.encode())))), depth=2)
    assert w.entries[0].reason == "depth-cap"
