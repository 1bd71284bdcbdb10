"""Undo HTTP transfer and content codings of a stored payload (worker code, no Spark imports)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

BLOCK = 16384
MAX_CHUNK = 2**31
SIZE_LINE = 64

#: name -> factory of an object with ``decompress`` and ``unused_data``; user code may add names.
DECOMPRESSORS: dict[str, Callable] = {
    "gzip": lambda: zlib.decompressobj(16 + zlib.MAX_WBITS),
    "deflate": lambda: zlib.decompressobj(),
    "deflate_alt": lambda: zlib.decompressobj(-zlib.MAX_WBITS),
}

try:  # optional, as a plug-in
    import brotli

    class _Brotli:
        unused_data = b""

        def __init__(self) -> None:
            self._d = brotli.Decompressor()

        def decompress(self, data: bytes) -> bytes:
            return self._d.process(data)

    DECOMPRESSORS["br"] = _Brotli
except ImportError:
    pass


class ChunkError(ValueError):
    """A violation of the chunk grammar, raised only on request."""


def chunks(data: bytes, strict: bool = False) -> Iterator[bytes]:
    """The pieces of a chunked body.

    From the first violation of the grammar on, the rest is passed on as it is. A bad terminator
    after a chunk costs the two bytes that were read in its place. A truncated last chunk is kept.
    """
    at, end = 0, len(data)
    while True:
        stop = data.find(b"\n", at, at + SIZE_LINE)
        head = data[at : stop + 1] if stop >= 0 else data[at : at + SIZE_LINE]
        at += len(head)
        size = _chunk_size(head)
        if size is None:
            if strict:
                raise ChunkError(f"no chunk size in {head!r}")
            yield head
            break
        if size == 0:
            tail = data[at : at + 2]
            at += 2
            if tail == b"\r\n":
                return
            if strict:
                raise ChunkError("the last chunk is not followed by an empty line")
            yield head
            break
        body = data[at : at + size]
        at += len(body)
        if len(body) < size:
            if strict:
                raise ChunkError(f"a chunk of {size} bytes ends after {len(body)}")
            yield body
            return
        tail = data[at : at + 2]
        at += 2
        if tail != b"\r\n":
            if strict:
                raise ChunkError("no line end after a chunk")
            yield head + body
            break
        yield body
    for k in range(min(at, end), end, BLOCK):
        yield data[k : k + BLOCK]


def _chunk_size(head: bytes) -> int | None:
    if head[-2:] != b"\r\n":
        return None
    try:
        size = int(head[:-2].split(b";")[0], 16)
    except ValueError:
        return None
    return size if 0 <= size <= MAX_CHUNK else None


def inflate(blocks: Iterator[bytes], kind: str, all_members: bool = False) -> tuple[bytes, str | None]:
    """Decompress a stream of blocks; the second value tells of an error after some output.

    A stream that fails before it gave any output was not compressed: deflate is tried again
    without the zlib wrapper, then the bytes pass as they are. A failure later ends the output.
    Only the first gzip member counts unless ``all_members`` is set.
    """
    if kind not in DECOMPRESSORS:
        raise ValueError(f"unknown content coding: {kind}")
    name, tool, out, error = kind, DECOMPRESSORS[kind](), [], None
    produced = 0
    silent = b""  # what was read without any output so far: read again if it turns out not to be compressed this way
    for block in blocks:
        while block:
            if tool is None:
                out.append(block)
                break
            try:
                got = tool.decompress(block)
            except Exception as e:  # zlib.error, or that of a plug-in
                if produced == 0:
                    block, silent = silent + block, b""
                    name, tool = ("deflate_alt", DECOMPRESSORS["deflate_alt"]()) if name == "deflate" else (name, None)
                    continue
                return b"".join(out), str(e)
            out.append(got)
            produced += len(got)
            silent = b"" if produced else silent + block
            rest = tool.unused_data
            if not rest:
                break
            if not all_members:
                return b"".join(out), error
            tool, block, produced, silent = DECOMPRESSORS[name](), rest, 0, b""
    return b"".join(out), error


def decode_content(payload: bytes | None, transfer: str | None, coding: str | None, all_members: bool = False) -> tuple[bytes | None, str | None]:
    """(content, warning) of a payload.

    ``transfer`` counts only when it is exactly ``chunked``; ``coding`` in any case, and only if it
    is a known one. A null payload gives null.
    """
    if payload is None:
        return None, None
    kind = (coding or "").lower()
    chunked = transfer == "chunked"
    if kind not in DECOMPRESSORS:
        return (b"".join(chunks(payload)), None) if chunked else (payload, None)
    blocks = chunks(payload) if chunked else (payload[k : k + BLOCK] for k in range(0, len(payload), BLOCK))
    return inflate(blocks, kind, all_members)
