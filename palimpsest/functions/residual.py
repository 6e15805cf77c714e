"""What a policy would have matched in a payload that was not inspected, read in five ways."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

from palimpsest.functions.matching import Matcher

# Fixed values: (bytes a character, which of them counts), and bytes read at once.
READINGS = ((1, 0), (2, 0), (2, 1), (4, 0), (4, 3))
CHUNK = 64 << 10


class Residual(NamedTuple):
    hits: int
    labels: dict[str, int]
    truncated: bool

    def summary(self) -> str:
        """`label×n` in order of the labels; never what was matched."""
        if not self.hits:
            return ""
        return ", ".join(f"{k}×{self.labels[k]}" for k in sorted(self.labels)) + " (partial scan)" * self.truncated


def readings(chunk: bytes) -> list[str]:
    """The chunk's text under each reading; bytes that can't be part of a text end a run, as a newline."""
    if len(chunk) < 2:
        return []
    data, out = np.frombuffer(chunk, np.uint8), []
    for width, at in READINGS:
        units = data[: len(data) // width * width].reshape(-1, width)
        own = units[:, at]
        padding = (np.delete(units, at, axis=1) == 0).all(axis=1)
        text = np.where(padding & (own >= 32) & (own != 127), own, 10).astype(np.uint8)
        out.append(text.tobytes().decode("utf-8", "surrogateescape"))
    return out


def scan(payload: bytes, matcher: Matcher, budget: int, chunk: int = CHUNK) -> Residual:
    """Reads no more than budget bytes, some at a time; only a partial unit is carried over."""
    labels: Counter[str] = Counter()
    carry, read = b"", min(len(payload), budget)
    for at in range(0, read, chunk):
        own = carry + payload[at : min(at + chunk, read)]
        carry = b""
        if (rest := len(own) % 4) and at + chunk <= read:
            own, carry = own[:-rest], own[-rest:]
        for text in readings(own):
            labels.update(m.replacement for m in matcher.scrub(text)[1])
    return Residual(sum(labels.values()), dict(labels), len(payload) > budget)
