"""URL filters: rules indexed by their rarest literal token, so that few regular expressions run for a URL.

A rule has a host, a path and a verdict. It fits its host and all subdomains (`*`: any host) if the URL's
path matches the rule's from its start; `*` in a path stands for any run of characters. A rule is filed
under that of its literal tokens (host labels, and path words that are whole in every URL that it fits)
which the fewest rules have; rules without one are candidates for every URL. A URL's own tokens fetch the
candidates, and only their expressions run. Of the rules that fit, the longest wins. Where none fits, the
patterns (rules of the same kind) decide, and where none of them fits, the default.

Rules are sent to the executors in blocks of bounded size; of several blocks' results the longest wins.

Defined results: a null URL, or one without `://`, has an empty host and path, and gets the default if no
rule fits; equal lengths go to the smaller rule; rows that repeat stay repeated; an empty table gives no
rows; all other columns are left out whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_batch

#: Rules that are sent at once, at most; each may be as long as MOST_CHARS.
MOST_RULES, MOST_CHARS = 200_000, 2_000

TOKEN = re.compile(r"\w+")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, in lower case A-Z."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Then up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: str, path: str) -> set[str]:
    return {"." + label for label in host.split(".") if label} | {"/" + t for t in TOKEN.findall(path)}


def literal_tokens(rule: Rule) -> set[str]:
    """Tokens of every URL that the rule fits: a path's word counts if the rule itself ends it on both sides."""
    out = set() if rule.host == "*" else tokens_of(rule.host, "")
    for i, part in enumerate(rule.path.split("*")):
        for m in TOKEN.finditer(part):
            if m.end() < len(part) and (m.start() > 0 or i == 0):
                out.add("/" + m[0])
    return out


class Index:
    """Rules by token."""

    def __init__(self, rules: list[Rule]) -> None:
        counts = Counter(t for r in rules for t in literal_tokens(r))
        self.by_token: dict[str, list[Rule]] = {}
        self.rest: list[Rule] = []
        self.compiled: dict[Rule, tuple[re.Pattern, re.Pattern]] = {}
        for r in rules:
            if tokens := literal_tokens(r):
                rarest = min(tokens, key=lambda t: (counts[t], -len(t), t))
                self.by_token.setdefault(rarest, []).append(r)
            else:
                self.rest.append(r)

    def candidates(self, host: str, path: str) -> list[Rule]:
        return self.rest + [r for t in tokens_of(host, path) for r in self.by_token.get(t, ())]

    def fits(self, rule: Rule, host: str, path: str) -> bool:
        if rule not in self.compiled:
            h = ".*" if rule.host == "*" else r"(?:.*\.)?" + re.escape(rule.host)
            self.compiled[rule] = (re.compile(h, re.S), re.compile(".*".join(map(re.escape, rule.path.split("*"))), re.S))
        h, p = self.compiled[rule]
        return bool(h.fullmatch(host) and p.match(path))

    def best(self, host: str, path: str) -> Rule | None:
        found = [r for r in self.candidates(host, path) if self.fits(r, host, path)]
        return min(found, key=lambda r: (-len(r.text), r.text), default=None)


def fitted(rows: DataFrame, rules: list[Rule], rule: str, verdict: str) -> DataFrame:
    """rows (with host and path) and two columns: the text and verdict of the longest rule that fits; null if none."""
    rows = rows.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(None).cast("string")})
    if any(len(r.text) > MOST_CHARS for r in rules):
        raise ValueError(f"a rule has more than {MOST_CHARS} characters")
    for at in range(0, len(rules), MOST_RULES):
        index = rows.sparkSession.sparkContext.broadcast(rules[at : at + MOST_RULES])
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch], index=index, names=names) -> Iterator[pa.RecordBatch]:
            found = Index(index.value)
            for b in batches:
                columns = dict(zip(names, b.columns, strict=True))
                texts, verdicts = columns[rule].to_pylist(), columns[verdict].to_pylist()
                for i, (host, path) in enumerate(zip(columns["host"].to_pylist(), columns["path"].to_pylist(), strict=True)):
                    best = found.best(host, path)
                    if best and (texts[i] is None or (-len(best.text), best.text) < (-len(texts[i]), texts[i])):
                        texts[i], verdicts[i] = best.text, best.verdict
                columns |= {rule: pa.array(texts, pa.string()), verdict: pa.array(verdicts, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

        rows = by_batch(rows, run, rows.schema)
    return rows


def judge(pages: DataFrame, rules: list[Rule], patterns: list[Rule] = (), default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = fitted(fitted(rows, list(rules), "rule", "verdict"), list(patterns), "pattern", "otherwise")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", "otherwise", F.lit(default)).alias("verdict"))
