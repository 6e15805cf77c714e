"""Patterns in RE2 syntax, parsed once and written for the JVM's and Python's engines with RE2's meaning.

RE2 reads \\b, \\d, \\w and \\s as ASCII, `.` as all but a newline, `$` as the end of the text, and (?i) as Unicode simple
folding. The other engines differ in each, so every such construct is written out. What RE2 has not
(lookaround, back references, possessive repeats, repeats above 1000) is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = ((48, 57), (65, 90), (95, 95), (97, 122))
CLASSES = {"d": ((48, 57),), "w": WORD, "s": ((9, 10), (12, 13), (32, 32))}
POSIX = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)), "cntrl": ((0, 31), (127, 127)), "digit": ((48, 57),), "graph": ((33, 126),),
    "lower": ((97, 122),), "print": ((32, 126),), "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ((9, 13), (32, 32)), "upper": ((65, 90),), "word": WORD, "xdigit": ((48, 57), (65, 70), (97, 102)),
}
LAST = 0x10FFFF
CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
MOST_REPEATS = 1000

Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """A pattern that RE2 would not take, or that can't be written for the other engines."""


@dataclass
class Node:
    """kind: set (ranges), cat, alt, repeat, group, begin, end, line_begin, line_end, edge, no_edge."""

    kind: str
    parts: list[Node] = field(default_factory=list)
    ranges: Ranges = ()
    fold: bool = False
    low: int = 1
    high: int | None = 1
    lazy: bool = False


def merged(ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def inverse(ranges) -> Ranges:
    out, at = [], 0
    for a, b in merged(ranges):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    if at <= LAST:
        out.append((at, LAST))
    return tuple(out)


class Parser:
    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern, 0
        self.flags = {"i": False, "m": False, "s": False}

    def fail(self, why: str) -> PatternError:
        return PatternError(f"{why} in pattern {self.s!r}")

    def more(self) -> bool:
        return self.i < len(self.s)

    def take(self, text: str) -> bool:
        if self.s.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def parse(self) -> Node:
        node = self.alternatives()
        if self.more():
            raise self.fail("unexpected )")
        return node

    def alternatives(self) -> Node:
        flags, parts = dict(self.flags), [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        self.flags = flags
        return parts[0] if len(parts) == 1 else Node("alt", parts)

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.more() and self.s[self.i] not in "|)":
            if (atom := self.atom()) is not None:
                parts += self.repeated(atom)
        return parts[0] if len(parts) == 1 else Node("cat", parts)

    def repeated(self, atom: list[Node]) -> list[Node]:
        """The atoms, the last of them with the repeats that follow."""
        count = 0
        while self.more():
            if self.s[self.i] in "*+?":
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.s[self.i]]
                self.i += 1
            elif m := re.compile(r"\{(\d+)(,(\d*))?\}").match(self.s, self.i):
                low = int(m[1])
                high = low if not m[2] else int(m[3]) if m[3] else None
                if max(low, high or 0) > MOST_REPEATS or high is not None and high < low:
                    raise self.fail("bad repeat count")
                self.i = m.end()
            else:
                break
            if not atom or count:
                raise self.fail("repeat of nothing" if not atom else "repeat of a repeat")
            count += 1
            lazy = self.take("?")
            atom = [*atom[:-1], Node("repeat", [atom[-1]], low=low, high=high, lazy=lazy)]
        return atom

    def one(self, ranges) -> Node:
        return Node("set", ranges=merged(ranges), fold=self.flags["i"])

    def atom(self) -> list[Node] | None:
        c = self.s[self.i]
        if c == "(":
            return self.group()
        self.i += 1
        if c == "[":
            return [self.char_class()]
        if c == ".":
            return [Node("set", ranges=((0, LAST),) if self.flags["s"] else inverse([(10, 10)]))]
        if c == "^":
            return [Node("line_begin" if self.flags["m"] else "begin")]
        if c == "$":
            return [Node("line_end" if self.flags["m"] else "end")]
        if c in "*+?":
            raise self.fail("repeat of nothing")
        if c == "\\":
            return self.escape()
        return [self.one([(ord(c), ord(c))])]

    def group(self) -> list[Node] | None:
        self.i += 1
        if not self.take("?"):
            return [self.closed()]
        if m := re.compile(r"P?<([A-Za-z_]\w*)>").match(self.s, self.i):
            self.i = m.end()
            return [self.closed()]
        if m := re.compile(r"([imsU]*)(?:-([imsU]*))?([:)])").match(self.s, self.i):
            on, off, end = m[1], m[2] or "", m[3]
            if "U" in on + off:
                raise self.fail("(?U) is not taken")
            self.i, before = m.end(), dict(self.flags)
            self.flags |= dict.fromkeys(on, True) | dict.fromkeys(off, False)
            if end == ")":
                return None
            node = self.closed()
            self.flags = before
            return [node]
        raise self.fail("a group that RE2 has not")

    def closed(self) -> Node:
        node = self.alternatives()
        if not self.take(")"):
            raise self.fail("missing )")
        return Node("group", [node])

    def escape(self) -> list[Node]:
        if not self.more():
            raise self.fail("trailing backslash")
        c = self.s[self.i]
        self.i += 1
        if c in "bB":
            return [Node("edge" if c == "b" else "no_edge")]
        if c in "Az":
            return [Node("begin" if c == "A" else "end")]
        if c == "Q":
            end = self.s.find("\\E", self.i)
            text, self.i = (self.s[self.i :], len(self.s)) if end < 0 else (self.s[self.i : end], end + 2)
            return [self.one([(ord(x), ord(x))]) for x in text]
        if c.lower() in CLASSES:
            return [Node("set", ranges=CLASSES[c] if c in CLASSES else inverse(CLASSES[c.lower()]))]
        return [self.one([(self.point(c),) * 2])]

    def point(self, c: str) -> int:
        """The code point of an escape that stands for one."""
        if c in CONTROL:
            return CONTROL[c]
        if c == "x":
            if m := re.compile(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})").match(self.s, self.i):
                self.i = m.end()
                return int(m[1] or m[2], 16)
            raise self.fail("bad \\x")
        if c == "0" or c in "1234567" and re.match(r"[0-7]{2}", self.s[self.i :]):
            m = re.compile(r"[0-7]{0,2}").match(self.s, self.i)
            self.i = m.end()
            return int(c + m[0], 8)
        if c.isascii() and c.isalnum():
            raise self.fail(f"unknown escape \\{c}")
        return ord(c)

    def char_class(self) -> Node:
        negated, ranges, first = self.take("^"), [], True
        while True:
            if not self.more():
                raise self.fail("missing ]")
            if self.s[self.i] == "]" and not first:
                self.i += 1
                break
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.s, self.i):
                if m[2] not in POSIX:
                    raise self.fail("unknown class name")
                ranges += inverse(POSIX[m[2]]) if m[1] else POSIX[m[2]]
                self.i = m.end()
                continue
            a = self.class_point()
            if isinstance(a, tuple):
                ranges += a
                continue
            b = a
            if self.s.startswith("-", self.i) and self.i + 1 < len(self.s) and self.s[self.i + 1] != "]":
                self.i += 1
                b = self.class_point()
                if isinstance(b, tuple) or b < a:
                    raise self.fail("bad range")
            ranges.append((a, b))
        if self.flags["i"] and negated:  # what folds into the class is out as well
            ranges += [(ord(y), ord(y)) for a, b in merged(ranges) if b - a < 512 for x in range(a, b + 1) for y in (chr(x).lower(), chr(x).upper()) if len(y) == 1]
        out = self.one(ranges)
        return Node("set", ranges=inverse(ranges)) if negated else out

    def class_point(self) -> int | tuple:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        if not self.more():
            raise self.fail("trailing backslash")
        c = self.s[self.i]
        self.i += 1
        if c.lower() in CLASSES:
            return CLASSES[c] if c in CLASSES else inverse(CLASSES[c.lower()])
        return self.point(c)


def parse(pattern: str) -> Node:
    return Parser(pattern).parse()


def may_be_empty(n: Node) -> bool:
    """Whether it can match an empty string."""
    if n.kind == "set":
        return False
    if n.kind in ("cat", "group"):
        return all(map(may_be_empty, n.parts))
    if n.kind == "alt":
        return any(map(may_be_empty, n.parts))
    if n.kind == "repeat":
        return n.low == 0 or may_be_empty(n.parts[0])
    return True


@dataclass(frozen=True)
class Need:
    """Of every match: one of these characters or one of these strings at least. weight: how common that is in text, roughly."""

    weight: float
    ranges: Ranges = ()
    strings: tuple[str, ...] = ()

    def __or__(self, other: Need) -> Need:
        return Need(self.weight + other.weight, merged([*self.ranges, *other.ranges]), tuple(dict.fromkeys([*self.strings, *other.strings])))

    def pattern(self, java: bool) -> str:
        parts = ([class_text(self.ranges, java)] if self.ranges else []) + ["".join(point_text(ord(c), java) for c in x) for x in self.strings]
        return "|".join(parts)


def common(ranges: Ranges) -> float:
    """How common the characters are, roughly, with a small letter as 1."""
    total = 0.0
    for a, b in ranges:
        for x in range(a, min(b, 127) + 1):
            c = chr(x)
            total += 1 if c.islower() or c in ".," else 4 if c == " " else 0.05 if c.isalnum() or c in "-'\n" else 0.01
        total += 1 if b > 127 else 0
    return total


def needed(n: Node) -> Need | None:
    """What every match holds; None if nothing is certain."""
    if n.kind == "set":
        out = n.ranges
        if n.fold:
            out = merged([*out, *[(ord(y), ord(y)) for a, b in out if b - a < 512 for x in range(a, b + 1) for y in folds(x)]])
        return Need(common(out), out)
    if n.kind in ("cat", "group"):
        found, run = [x for x in map(needed, n.parts) if x is not None], ""
        for p in [*n.parts, Node("end")]:
            if p.kind == "set" and not p.fold and len(p.ranges) == 1 and p.ranges[0][0] == p.ranges[0][1]:
                run += chr(p.ranges[0][0])
                continue
            if len(run) > 1:
                found.append(Need(min(common(((ord(c), ord(c)),)) for c in run) * 0.1 ** (len(run) - 1), (), (run,)))
            run = ""
        return min(found, key=lambda x: x.weight, default=None)
    if n.kind == "alt":
        sets = list(map(needed, n.parts))
        if None in sets:
            return None
        out = sets[0]
        for x in sets[1:]:
            out = out | x
        return out
    if n.kind == "repeat" and n.low:
        return needed(n.parts[0])
    return None


def folds(point: int) -> set[str]:
    c = chr(point)
    out = {x for x in (c.lower(), c.upper()) if len(x) == 1}
    return out | ({"K"} if c in "kK" else set()) | ({"ſ"} if c in "sS" else set())


def all_word(ranges: Ranges) -> bool:
    return all(any(a >= x and b <= y for x, y in WORD) for a, b in ranges)


def outer_is_word(n: Node, at: int) -> bool:
    """Whether every match's first (at 0) or last (at -1) character is an ASCII word character."""
    if n.kind == "set":
        return bool(n.ranges) and all_word(n.ranges) and not (n.fold and any(not x.isascii() for a, b in n.ranges for p in range(a, b + 1) for x in folds(p)))
    if n.kind == "group":
        return outer_is_word(n.parts[0], at)
    if n.kind == "alt":
        return all(outer_is_word(p, at) for p in n.parts)
    if n.kind == "repeat":
        return n.low > 0 and outer_is_word(n.parts[0], at)
    if n.kind == "cat":
        parts = [p for p in n.parts if p.kind not in ("edge", "no_edge", "begin", "end", "line_begin", "line_end")]
        for p in parts if at == 0 else reversed(parts):
            if p.kind == "repeat" and p.low == 0:  # it may be absent, and then the next one counts
                if not outer_is_word(p.parts[0], at):
                    return False
            else:
                return outer_is_word(p, at)
    return False


W = "[0-9A-Za-z_]"
EDGE = f"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"


def point_text(p: int, java: bool) -> str:
    if chr(p).isascii() and chr(p).isalnum():
        return chr(p)
    return f"\\x{{{p:x}}}" if java else f"\\x{p:02x}" if p < 256 else f"\\u{p:04x}" if p < 65536 else f"\\U{p:08x}"


def class_text(ranges: Ranges, java: bool) -> str:
    if not ranges:
        return r"[^\x{0}-\x{10ffff}]" if java else r"[^\x00-\U0010ffff]"
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return point_text(ranges[0][0], java)
    return "[" + "".join(point_text(a, java) + (f"-{point_text(b, java)}" if b > a else "") for a, b in ranges) + "]"


def write(n: Node, java: bool, before: Node | None = None, after: Node | None = None) -> str:
    if n.kind == "set":
        text = class_text(n.ranges, java)
        return (f"(?iu:{text})" if java else f"(?i:{text})") if n.fold else text
    if n.kind == "cat":
        out = []
        for i, p in enumerate(n.parts):
            out.append(write(p, java, n.parts[i - 1] if i else before, n.parts[i + 1] if i + 1 < len(n.parts) else after))
        return "".join(out)
    if n.kind == "alt":
        return "(?:" + "|".join(write(p, java, before, after) for p in n.parts) + ")"
    if n.kind == "group":
        return "(?:" + write(n.parts[0], java, before, after) + ")"
    if n.kind == "repeat":
        inner = write(n.parts[0], java)
        if n.parts[0].kind not in ("set", "group", "alt"):
            inner = f"(?:{inner})"
        count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.low, n.high)) or (f"{{{n.low}}}" if n.low == n.high else f"{{{n.low},{'' if n.high is None else n.high}}}")
        return inner + count + "?" * n.lazy
    if n.kind == "edge":
        if after is not None and outer_is_word(after, 0):
            return f"(?<!{W})"
        if before is not None and outer_is_word(before, -1):
            return f"(?!{W})"
        return EDGE
    return {"no_edge": f"(?:(?<={W})(?={W})|(?<!{W})(?!{W}))", "begin": r"\A", "end": r"\z" if java else r"\Z", "line_begin": r"(?:\A|(?<=\n))", "line_end": r"(?:\z|(?=\n))" if java else r"(?:\Z|(?=\n))"}[n.kind]


def for_java(pattern: str) -> str:
    return write(parse(pattern), True)


def for_python(pattern: str) -> str:
    return write(parse(pattern), False)


def quoted(text: str) -> str:
    """Text as a pattern that matches itself."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)
