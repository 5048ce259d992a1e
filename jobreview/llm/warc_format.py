"""Reading WARC/1.1 records from bytes that arrive in pieces."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

CRLF = b"\r\n"
END = CRLF + CRLF


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of one or more gzip members, or the bytes themselves."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    unzip = zlib.decompressobj(31)
    for i in range(0, len(view), step):
        part = bytes(view[i : i + step])
        while part:
            yield unzip.decompress(part)
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            else:
                break
    yield unzip.flush()


def headers_of(block: bytes) -> list[tuple[str, str]]:
    """Field names in lower case, in order; lines that continue are joined."""
    fields: list[tuple[str, str]] = []
    for line in block.split(CRLF):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + text.strip())
        elif ":" in text:
            name, _, value = text.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return fields


def records(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of each record. Blocks are cut by their stated length, so
    a payload may hold anything. Bytes that start no record raise."""
    buffer = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while fill(2) and buffer[:2] == CRLF:
            del buffer[:2]
        if not fill(1):
            return
        at, seen = -1, 0
        while (at := buffer.find(END, seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("a WARC record ends within its header")
        if not buffer.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts at {bytes(buffer[:20])!r}")
        fields = headers_of(bytes(buffer[buffer.find(CRLF) + 2 : at]))
        del buffer[: at + 4]
        length = int(dict(fields)["content-length"])
        if not fill(length):
            raise ValueError("a WARC record is shorter than its length")
        block = bytes(memoryview(buffer)[:length])
        del buffer[:length]
        yield fields, block


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP fields and payload of a block."""
    head, _, payload = block.partition(END)
    return headers_of(head), payload


def hex_digest(value: str | None) -> str | None:
    """A digest field as lower-case hex: ``sha1:`` in base 32 or hex, or bare."""
    if not value:
        return None
    digest = value.partition(":")[2] or value
    if len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()
