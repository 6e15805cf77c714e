"""Finding spans, naming their rule and rewriting the text: on Python strings, for leaves of bundles."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from palimpsest.functions import validators
from palimpsest.plans import regex
from palimpsest.plans.policy import Policy, Rule


class Match(NamedTuple):
    rule: str
    line: int
    offset: int
    original: str
    replacement: str


def byte_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogateescape"))


class Matcher:
    """A policy compiled to one alternation. Bytes that are no UTF-8 come as lone surrogates, one each, and leave as they came."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy
        self.combined = re.compile("|".join(f"(?:{regex.for_python(r.pattern)})" for r in policy.rules))
        self.single = [(r, re.compile(regex.for_python(r.pattern))) for r in policy.rules]
        need = policy.needed()
        self.needed = re.compile(need.pattern(False)) if need else None
        self.known: dict[str, tuple[Rule | None, bool]] = {}

    def __reduce__(self):
        return Matcher, (self.policy,)

    def attribute(self, span: str) -> tuple[Rule | None, bool]:
        """The first rule that takes the span alone as a whole, else the first that matches anywhere in it; and whether its validator accepts it."""
        if (got := self.known.get(span)) is None:
            found = [(r, m.span()) for r, p in self.single if (m := p.search(span))]
            rule = next((r for r, at in found if at == (0, len(span))), found[0][0] if found else None)
            got = rule, rule is not None and (rule.validator is None or validators.PYTHON[rule.validator](span))
            if len(self.known) < 100_000:
                self.known[span] = got
        return got

    def spans(self, text: str) -> Iterator[re.Match]:
        """Leftmost spans without overlap; an empty one that abuts the one before doesn't count."""
        if self.needed and not self.needed.search(text):
            return
        end = -1
        for m in self.combined.finditer(text):
            if m.start() == m.end() == end:
                continue
            end = m.end()
            yield m

    def scrub(self, text: str) -> tuple[str, list[Match]]:
        """The rewritten text and its matches. A span that its rule's validator rejects stays, and nothing else is sought in it."""
        out, matches, at, offset, counted, newlines = [], [], 0, 0, 0, None
        for m in self.spans(text):
            rule, valid = self.attribute(span := m[0])
            if not valid:
                continue
            if newlines is None:
                newlines = [i.start() for i in re.finditer("\n", text)]
            offset += byte_length(text[counted : m.start()])
            counted = m.start()
            label = self.policy.replacement(rule)
            out += (text[at : m.start()], label)
            at = m.end()
            matches.append(Match(rule.id, bisect_right(newlines, m.start() - 1) + 1, offset, span, label))
        if not matches:
            return text, []
        return "".join([*out, text[at:]]), matches

    def scrub_name(self, name: str) -> tuple[str, list[Match]]:
        """Each segment of a path on its own; what is put in never adds a separator."""
        out, matches = [], []
        for part in name.split("/"):
            fresh, found = (part, []) if part in ("", ".", "..") else self.scrub(part)
            out.append(re.sub(r"[/\\]", "_", fresh) if found else part)
            matches += found
        return "/".join(out), matches
