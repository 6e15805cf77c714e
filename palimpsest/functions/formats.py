"""Container formats by their first bytes: as a Column, and on bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures, in the order in which they are tried.
SIGNATURES = (
    ("zip", b"PK\x03\x04"),
    ("zip", b"PK\x05\x06"),
    ("gzip", b"\x1f\x8b"),
    ("bzip2", b"BZh"),
    ("xz", b"\xfd7zXZ\x00"),
    ("zstd", b"\x28\xb5\x2f\xfd"),
    ("7z", b"7z\xbc\xaf\x27\x1c"),
    ("rar", b"Rar!\x1a\x07\x01\x00"),
    ("rar", b"Rar!\x1a\x07\x00"),
)
HEAD = 512
WRITABLE = ("gzip", "zlib", "xz", "zstd")


def octal(field: bytes) -> int:
    """A number as tar headers write it; -1 if it is none."""
    digits = field.strip(b"\0 ")
    digits = digits.split(b"\0")[0].split(b" ")[0]
    return int(digits, 8) if digits and not digits.strip(b"01234567") else -1


def is_tar(head: bytes) -> bool:
    if len(head) < HEAD or head[257:262] != b"ustar":
        return False
    return octal(head[148:156]) == sum(head[:148]) + 8 * 32 + sum(head[156:HEAD])


def is_zlib(head: bytes) -> bool:
    return len(head) >= 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


def detect(head: bytes) -> str:
    """The format; empty for a plain file. A zlib header is weak: only inflating proves it."""
    for name, signature in SIGNATURES:
        if head.startswith(signature) and (name != "bzip2" or head[3:4] in (b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")):
            return name
    return "zlib" if is_zlib(head) else "tar" if is_tar(head[:HEAD]) else ""


def detect_column(content: Column) -> Column:
    """The same, of a binary column; only its first bytes are looked at."""
    head = F.hex(F.substring(content, 1, HEAD))
    out = F.lit(None).cast("string")
    two = F.conv(F.substring(head, 1, 4), 16, 10).cast("int")
    stored = F.regexp_extract(F.decode(F.substring(content, 149, 8), "ISO-8859-1"), r"^[\x00 ]*([0-7]+)(?:[\x00 ].*)?$", 1)
    at = F.sequence(F.lit(0), F.lit(HEAD - 1))
    byte = lambda i: F.conv(F.substring(head, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when((i >= 148) & (i < 156), 32).otherwise(byte(i)))
    tar = (F.length(head) == 2 * HEAD) & (F.substring(head, 515, 10) == b"ustar".hex().upper()) & (F.conv(stored, 8, 10).cast("int") == total)
    for name, signature in SIGNATURES:
        hit = head.startswith(signature.hex().upper())
        if name == "bzip2":
            hit = hit & F.substring(head, 7, 2).between("31", "39")
        out = F.coalesce(out, F.when(hit, name))
    zlib = (F.length(head) >= 4) & (two.bitwiseAND(0x0F00) == 0x0800) & (two % 31 == 0)
    return F.coalesce(out, F.when(zlib, "zlib"), F.when(tar, "tar"), F.lit(""))
