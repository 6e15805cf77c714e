"""Text encodings: what a payload is, its text, and the same bytes back."""

from __future__ import annotations

import numpy as np

# When bytes without a mark count as UTF-16 or UTF-32, and when text counts as binary.
LEAST_UTF16, SHARE_UTF16, SKEW_UTF16 = 16, 30, 8
LEAST_UTF32, SHARE_UTF32 = 32, 50
CONTROL_SHARE = 10
SAMPLE = 8192

MARKS = ((b"\xff\xfe\x00\x00", "utf-32le"), (b"\x00\x00\xfe\xff", "utf-32be"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
UTF8_MARK = b"\xef\xbb\xbf"


def sniff(sample: bytes) -> str:
    """utf-8, utf-16le, utf-16be, utf-32le, utf-32be or binary, by the first bytes of a payload."""
    if not sample:
        return "utf-8"
    for mark, name in MARKS:
        if sample.startswith(mark):
            return name
    return wide_without_mark(sample) or ("binary" if looks_binary(sample) else "utf-8")


def wide_without_mark(sample: bytes) -> str | None:
    """UTF-32 or UTF-16 by where the zero bytes lie."""
    zero = np.frombuffer(sample, np.uint8) == 0
    if (n := len(zero) // 4) * 4 >= LEAST_UTF32:
        units = zero[: n * 4].reshape(n, 4)
        little, big = int(units[:, 1:].all(axis=1).sum()), int(units[:, :3].all(axis=1).sum())
        if little * 100 >= n * SHARE_UTF32 and little > big:
            return "utf-32le"
        if big * 100 >= n * SHARE_UTF32 and big > little:
            return "utf-32be"
    if (n := len(zero) // 2) * 2 >= LEAST_UTF16:
        even, odd = (int(x) for x in zero[: n * 2].reshape(n, 2).sum(axis=0))
        if odd * 100 >= n * SHARE_UTF16 and odd >= even * SKEW_UTF16:
            return "utf-16le"
        if even * 100 >= n * SHARE_UTF16 and even >= odd * SKEW_UTF16:
            return "utf-16be"
    return None


def looks_binary(sample: bytes) -> bool:
    """A zero byte, or bytes that are no UTF-8 (but for a cut last character) with many controls among them."""
    rest = sample.removeprefix(UTF8_MARK)
    if b"\0" in rest:
        return True
    if not rest:
        return False
    try:
        rest.decode()
        return False
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and 0 < e.start and len(rest) - e.start < 4:
            return False
    b = np.frombuffer(rest, np.uint8)
    control = int(((b < 9) | (b > 13) & (b < 32)).sum())
    return control * 100 // len(b) > CONTROL_SHARE


def mostly_control(text: str) -> bool:
    if not text:
        return False
    n = sum(c not in "\t\n\r" and (c < " " or c == "\x7f") for c in text)
    return n * 100 // len(text) > CONTROL_SHARE


def decode(data: bytes, encoding: str) -> tuple[str, str | None]:
    """The text, and why there is none: malformed or not-text. A mark stays, as U+FEFF."""
    if encoding == "utf-8":
        return data.decode("utf-8", "surrogateescape"), None
    if encoding == "binary":
        return "", "not-text"
    try:
        text = data.decode(encoding.replace("le", "-le").replace("be", "-be"))
    except UnicodeDecodeError:
        return "", "malformed"
    return ("", "not-text") if mostly_control(text) else (text, None)


def encode(text: str, encoding: str) -> bytes:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogateescape")
    return text.encode(encoding.replace("le", "-le").replace("be", "-be"))
