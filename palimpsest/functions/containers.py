"""Reading containers within bounds, and writing them again in the form they had."""

from __future__ import annotations

import copy
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from dataclasses import dataclass, field

import zstandard


class Refused(Exception):
    """why: expansion-budget, member-cap or malformed."""

    def __init__(self, why: str, detail: str) -> None:
        super().__init__(detail)
        self.why = why


@dataclass
class Member:
    name: str
    body: bytes
    regular: bool
    header: object


@dataclass
class Stream:
    """What a compressed stream's header says besides its data."""

    name: bytes = b""
    comment: bytes = b""
    mtime: int = 0
    system: int = 255
    extra: dict = field(default_factory=dict)


STEP = 1 << 20


def read_tar(data: bytes, budget: int, most: int) -> list[Member]:
    out, left = [], budget
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:", errors="surrogateescape") as tar:
            while (info := tar.next()) is not None:
                if len(out) >= most:
                    raise Refused("member-cap", f"tar has more than {most} members")
                body = b""
                if info.isreg():
                    if info.size > left:
                        raise Refused("expansion-budget", f"tar members exceed the {budget} bytes that are left")
                    body = tar.extractfile(info).read()
                    if len(body) < info.size:
                        raise Refused("malformed", "tar ends within a member")
                    left -= len(body)
                out.append(Member(info.name + "/" * (info.isdir() and not info.name.endswith("/")), body, info.isreg(), info))
            if data[tar.offset : tar.offset + 512].strip(b"\0"):
                raise Refused("malformed", "tar has a damaged header")
    except (tarfile.TarError, ValueError, EOFError, OSError) as e:
        raise Refused("malformed", f"tar can't be read: {e}") from None
    return out


def write_tar(members: list[Member], data: bytes) -> bytes:
    """Members in order, each with its header; sizes are those of the bodies."""
    out = io.BytesIO()
    gnu = data[257:265] == b"ustar  \0"
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT if gnu else tarfile.PAX_FORMAT, errors="surrogateescape") as tar:
        for m in members:
            info = copy.copy(m.header)
            info.pax_headers = {k: v for k, v in info.pax_headers.items() if k not in ("path", "size")}
            info.name = m.name.rstrip("/") if info.isdir() else m.name
            if m.regular:
                info.size = len(m.body)
            tar.addfile(info, io.BytesIO(m.body) if m.regular else None)
    return out.getvalue()


def read_zip(data: bytes, budget: int, most: int) -> list[Member]:
    out, left = [], budget
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > most:
                raise Refused("member-cap", f"zip has more than {most} members")
            for info in z.infolist():
                parts = []
                with z.open(info) as f:
                    while part := f.read(STEP):
                        parts.append(part)
                        left -= len(part)
                        if left < 0:
                            raise Refused("expansion-budget", f"zip members exceed the {budget} bytes that are left")
                body = b"".join(parts)
                out.append(Member(info.filename, body, not info.is_dir(), info))
    except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, struct.error) as e:
        raise Refused("malformed", f"zip can't be read: {e}") from None
    return out


def write_zip(members: list[Member], data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as z:
        z.comment = old.comment
        for m in members:
            info = copy.copy(m.header)
            info.filename, info.file_size = m.name, len(m.body)
            info.flag_bits &= 0x800
            z.writestr(info, m.body, compress_type=info.compress_type)
    return out.getvalue()


def gzip_header(data: bytes) -> Stream:
    """Of the first member: name, comment, time and system."""
    flags, at = data[3], 10
    out = Stream(mtime=int.from_bytes(data[4:8], "little"), system=data[9])
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit, name in ((8, "name"), (16, "comment")):
        if flags & bit:
            end = data.index(b"\0", at)
            setattr(out, name, data[at:end])
            at = end + 1
    return out


def inflate(data: bytes, budget: int, wbits: int, many: bool) -> bytes:
    out, size, rest = [], 0, data
    while rest:
        d = zlib.decompressobj(wbits)
        while not d.eof:
            part = d.decompress(rest, STEP)
            rest = d.unconsumed_tail
            out.append(part)
            size += len(part)
            if size > budget:
                raise Refused("expansion-budget", f"the stream exceeds the {budget} bytes that are left")
            if not part and not rest and not d.eof:
                raise Refused("malformed", "the stream ends early")
        rest = d.unused_data
        if not many:
            break
    return b"".join(out)


def decompress(kind: str, data: bytes, budget: int) -> tuple[bytes, Stream]:
    try:
        if kind == "gzip":
            return inflate(data, budget, 31, True), gzip_header(data)
        if kind == "zlib":
            return inflate(data, budget, 15, False), Stream()
        if kind == "xz":
            return unxz(data, budget), Stream()
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        parts, size = [], 0
        while part := reader.read(STEP):
            parts.append(part)
            size += len(part)
            if size > budget:
                raise Refused("expansion-budget", f"the stream exceeds the {budget} bytes that are left")
        if not whole_zstd(data):
            raise Refused("malformed", "the stream ends early")
        return b"".join(parts), Stream()
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, EOFError, OSError, ValueError, IndexError) as e:
        raise Refused("malformed", f"{kind} can't be read: {e}") from None


def whole_zstd(data: bytes) -> bool:
    """Whether the last frame ends where the data does."""
    rest = data
    while rest:
        d = zstandard.ZstdDecompressor().decompressobj()
        for at in range(0, len(rest), STEP):
            d.decompress(rest[at : at + STEP])
            if d.eof:
                rest = d.unused_data + rest[at + STEP :]
                break
        else:
            return False
    return True


def unxz(data: bytes, budget: int) -> bytes:
    out, size, rest = [], 0, data
    while rest.strip(b"\0"):
        d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        given = rest
        while not d.eof:
            part = d.decompress(given, STEP)
            given = b""
            out.append(part)
            size += len(part)
            if size > budget:
                raise Refused("expansion-budget", f"the stream exceeds the {budget} bytes that are left")
            if not part and d.needs_input:
                raise Refused("malformed", "the stream ends early")
        rest = d.unused_data
    return b"".join(out)


def compress(kind: str, data: bytes, stream: Stream) -> bytes:
    if kind == "gzip":
        flags = 8 * bool(stream.name) + 16 * bool(stream.comment)
        head = b"\x1f\x8b\x08" + bytes([flags]) + stream.mtime.to_bytes(4, "little") + b"\0" + bytes([stream.system])
        head += (stream.name + b"\0") * bool(stream.name) + (stream.comment + b"\0") * bool(stream.comment)
        c = zlib.compressobj(wbits=-15)
        return head + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if kind == "zlib":
        return zlib.compress(data)
    if kind == "xz":
        return lzma.compress(data)
    return zstandard.ZstdCompressor().compress(data)
