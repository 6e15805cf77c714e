"""The walk through an object: unpack, inspect every text leaf, rewrite, pack again, and account for all of it.

One call takes one object, since its budgets run over its members in order; objects are independent, so
the DataFrame operator is one pass without a shuffle, with an object a row in and out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import containers, encodings, formats, residual
from palimpsest.functions.matching import Match, Matcher
from palimpsest.plans.policy import Policy
from palimpsest.runtime import ship
from palimpsest.sources.objects import mark_of, store

STATUSES = ("scrubbed", "unchanged", "binary-skipped", "passthrough-error", "unsupported-format", "guard-tripped", "residual-match")
INSPECTED = ("scrubbed", "unchanged")
REASONS = ("binary", "encoding-unsupported", "residual-after-scrub", "malformed", "scratch-unavailable", "repack-failed", "unsupported-format", "depth-cap", "expansion-budget", "member-cap", "unclassified")


@dataclass(frozen=True)
class Limits:
    """A residual budget below zero turns the scan of what was not inspected off."""

    depth: int = 16
    total_bytes: int = 2 << 30
    members: int = 100_000
    residual_bytes: int = 64 << 20
    verify: bool = False
    names: bool = True


@dataclass
class Entry:
    path: str
    status: str
    reason: str | None
    detail: str
    bytes_in: int
    bytes_out: int
    matches: list[Match] = field(default_factory=list)
    residual_hits: int = 0
    residual: str = ""


class Walk:
    def __init__(self, matcher: Matcher, limits: Limits = Limits(), aborted: Callable[[], bool] = lambda: False) -> None:
        self.matcher, self.limits, self.aborted = matcher, limits, aborted
        self.entries: list[Entry] = []
        self.samples: list[str] = []
        self.left = self.residual_left = 0

    def run(self, path: str, data: bytes) -> tuple[bytes, bool]:
        """The object's new bytes, and whether they differ; `entries` then has a row for every file."""
        self.entries, self.samples = [], []
        self.left = self.limits.total_bytes if self.limits.total_bytes > 0 else Limits().total_bytes
        self.residual_left = self.limits.residual_bytes or Limits().residual_bytes
        return self.node(path, data, 0)

    def node(self, path: str, data: bytes, depth: int) -> tuple[bytes, bool]:
        if self.aborted():
            return data, False
        if depth > self.limits.depth:
            return self.hole(path, data, "guard-tripped", "depth-cap", f"nested deeper than {self.limits.depth}")
        kind = formats.detect(data[: formats.HEAD])
        if kind in ("zip", "tar"):
            return self.archive(kind, path, data, depth)
        if kind in formats.WRITABLE:
            return self.stream(kind, path, data, depth)
        if kind:
            return self.hole(path, data, "unsupported-format", "unsupported-format", f"{kind} can't be rewritten; passed through unchanged and not scrubbed")
        return self.leaf(path, data)

    def hole(self, path: str, data: bytes, status: str, reason: str, detail: str) -> tuple[bytes, bool]:
        """Content that goes out as it came; what the policy would have found in it is counted."""
        entry = Entry(path, status, reason, detail, len(data), len(data))
        self.entries.append(entry)
        self.look(entry, data)
        return data, False

    def look(self, entry: Entry, data: bytes) -> None:
        if self.limits.residual_bytes < 0 or self.residual_left <= 0 or not data:
            return
        found = residual.scan(data, self.matcher, self.residual_left)
        self.residual_left = max(0, self.residual_left - len(data))
        if found.hits:
            entry.residual_hits, entry.residual = found.hits, found.summary()
            self.samples.append(f"{entry.path} ({entry.reason}): {entry.residual}")

    def take_back(self, mark: int, path: str, data: bytes, status: str, reason: str, detail: str, look: bool) -> tuple[bytes, bool]:
        """Replaces all entries since the mark by one: what they report never reached an output."""
        del self.entries[mark:]
        entry = Entry(path, status, reason, detail, len(data), len(data))
        self.entries.append(entry)
        if look:
            self.look(entry, data)
        return data, False

    def leaf(self, path: str, data: bytes) -> tuple[bytes, bool]:
        encoding = encodings.sniff(data[: encodings.SAMPLE])
        text, refused = encodings.decode(data, encoding)
        if refused == "malformed":
            return self.hole(path, data, "binary-skipped", "encoding-unsupported", f"looks like {encoding} but is not well-formed; passed through unchanged")
        if refused:
            return self.hole(path, data, "binary-skipped", "binary", "detected binary content")
        fresh, matches = self.matcher.scrub(text)
        if not matches:
            self.entries.append(Entry(path, "unchanged", None, encoding, len(data), len(data)))
            return data, False
        if self.limits.verify and (again := self.matcher.scrub(fresh)[1]):
            detail = f"{len(again)} match(es) of rule {again[0].rule!r} survive in the result; emitted unchanged and not scrubbed"
            return self.take_back(len(self.entries), path, data, "residual-match", "residual-after-scrub", detail, False)
        out = encodings.encode(fresh, encoding)
        self.entries.append(Entry(path, "scrubbed", None, encoding, len(data), len(out), matches))
        return out, True

    def stream(self, kind: str, path: str, data: bytes, depth: int) -> tuple[bytes, bool]:
        mark = len(self.entries)
        try:
            inner, header = containers.decompress(kind, data, self.left)
        except containers.Refused as e:
            if e.why == "malformed" and kind == "zlib":
                return self.leaf(path, data)  # two bytes that plain text can have, too
            status = "passthrough-error" if e.why == "malformed" else "guard-tripped"
            return self.hole(path, data, status, e.why, str(e))
        self.left -= len(inner)
        out, changed = self.node(path, inner, depth + 1)
        if not changed:
            return data, False
        try:
            return containers.compress(kind, out, header), True
        except Exception as e:  # whatever the writer met: the original goes out, and is reported so
            return self.take_back(mark, path, data, "unsupported-format", "repack-failed", f"{kind} can't be written again ({e}); passed through unchanged and not scrubbed", True)

    def archive(self, kind: str, path: str, data: bytes, depth: int) -> tuple[bytes, bool]:
        mark, changed = len(self.entries), False
        read, write = (containers.read_zip, containers.write_zip) if kind == "zip" else (containers.read_tar, containers.write_tar)
        try:
            members = read(data, self.left, self.limits.members)
        except containers.Refused as e:
            return self.hole(path, data, "passthrough-error" if e.why == "malformed" else "guard-tripped", e.why, str(e))
        self.left -= sum(len(m.body) for m in members)
        for m in members:
            at = f"{path}!{m.name}"
            if self.limits.names and (found := self.matcher.scrub_name(m.name))[1]:
                m.name, matches = found
                self.entries.append(Entry(f"{at} [name]", "scrubbed", None, "filename scrubbed", len(m.body), len(m.name.encode("utf-8", "surrogateescape")), matches))
                changed = True
            if m.regular:
                m.body, own = self.node(at, m.body, depth + 1)
                changed |= own
        if self.aborted() or not changed:
            return data, False
        try:
            return write(members, data), True
        except Exception as e:  # as above
            return self.take_back(mark, path, data, "passthrough-error", "repack-failed", f"{kind} can't be rebuilt ({e}); passed through unchanged and not scrubbed", True)


MATCH = "struct<rule: string, line: int, offset: long, original: string, replacement: string>"
FILE = f"struct<path: string, status: string, reason: string, detail: string, bytes_in: long, bytes_out: long, matches: array<{MATCH}>, residual_hits: long, residual: string>"
WALKED = f"object_key string, output binary, changed boolean, error string, files array<{FILE}>, residual_samples array<string>"


def clean(text: str) -> str:
    """Text as Spark can hold it: bytes that are no UTF-8 show as U+FFFD."""
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


ABORTED = "aborted"


def marked(folder: str, key: str, every: float = 1.0) -> Callable[[], bool]:
    """Whether a key has been marked in a folder, looked up again once a second at most."""
    frm, at = store(folder)
    path, last = f"{at}/{mark_of(key)}", [0.0, False]

    def look() -> bool:
        now = time.monotonic()
        if not last[1] and now >= last[0]:
            last[:] = [now + every, frm.get_file_info(path).type == afs.FileType.File]
        return last[1]

    return look


def walked(objects: DataFrame, policies: dict[str, Policy], default: str, limits: Limits = Limits(), policy: Column | None = None, own_policy: Column | None = None, marks: str | None = None) -> DataFrame:
    """object_key, output, changed, error, files, residual_samples of each object (object_key, content, and read_error if there is one).

    policy: the name of the object's policy; own_policy: a policy of its own as JSON, which beats the name. An object that fails
    or could not be read is passed through with its error, and the others go on. marks: a folder in which the mark of a key
    aborts the object's walk.
    """
    ship(objects.sparkSession)
    unread = F.col("read_error") if "read_error" in objects.columns else F.lit(None).cast("string")
    rows = objects.select("object_key", "content", (policy if policy is not None else F.lit(default)).alias("name"), (own_policy if own_policy is not None else F.lit(None).cast("string")).alias("own"), unread.alias("unread"))
    sent = objects.sparkSession.sparkContext.broadcast(policies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for b in batches:
            for key, content, name, own, unread in zip(b.column(0).to_pylist(), b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                out, changed, error, walk = data, False, None, None
                try:
                    if unread is not None:
                        raise OSError(unread)
                    if own is not None:
                        matcher = Matcher(Policy.parse(own))
                    elif (matcher := matchers.get(name)) is None:
                        matcher = matchers[name] = Matcher(sent.value.get(name) or sent.value[default])
                    walk = Walk(matcher, limits, marked(marks, key or "") if marks else lambda: False)
                    out, changed = walk.run(key or "", data)
                    entries = walk.entries
                    if walk.aborted():
                        out, changed, error, entries = data, False, ABORTED, []
                except Exception as e:  # one object is lost to its error, not the job
                    out, changed, error = data, False, f"{type(e).__name__}: {e}"
                    entries = [Entry(key or "", "passthrough-error", "unclassified", error, len(data), len(data))]
                files = [
                    {"path": clean(e.path), "status": e.status, "reason": e.reason, "detail": clean(e.detail), "bytes_in": e.bytes_in, "bytes_out": e.bytes_out, "residual_hits": e.residual_hits, "residual": e.residual,
                     "matches": [{"rule": m.rule, "line": m.line, "offset": m.offset, "original": clean(m.original), "replacement": m.replacement} for m in e.matches]}
                    for e in entries
                ]
                yield pa.RecordBatch.from_pylist([{"object_key": key, "output": out, "changed": changed, "error": error, "files": files, "residual_samples": list(map(clean, walk.samples)) if walk else []}], schema=arrow_schema())

    return rows.mapInArrow(run, WALKED)


def arrow_schema() -> pa.Schema:
    match = pa.struct([("rule", pa.string()), ("line", pa.int32()), ("offset", pa.int64()), ("original", pa.string()), ("replacement", pa.string())])
    file = pa.struct([("path", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("detail", pa.string()), ("bytes_in", pa.int64()), ("bytes_out", pa.int64()), ("matches", pa.list_(match)), ("residual_hits", pa.int64()), ("residual", pa.string())])
    return pa.schema([("object_key", pa.string()), ("output", pa.binary()), ("changed", pa.bool_()), ("error", pa.string()), ("files", pa.list_(file)), ("residual_samples", pa.list_(pa.string()))])


def samples(objects: DataFrame) -> DataFrame:
    """object_key, seq, sample: what was found in contents that were not inspected, those that were rolled back included."""
    return objects.select("object_key", F.posexplode("residual_samples").alias("seq", "sample"))


def files(objects: DataFrame) -> DataFrame:
    """A row a file: object_key, seq, and what is known of it, with its count of matches."""
    each = objects.select("object_key", F.posexplode("files").alias("seq", "f"))
    return each.select("object_key", "seq", "f.*").withColumn("match_count", F.size("matches").cast("long"))
