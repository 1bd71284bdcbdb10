"""Records as bytes (worker code)."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Any

from quarry.codec.digest import digest_of
from quarry.codec.headers import Block, Header, ascii_bytes, get, removed, replaced, text_of

NO_PAYLOAD_DIGEST = ("warcinfo", "revisit")


def finished(row: dict[str, Any], keep: Callable[[Header], Header | None] | None = None) -> tuple[list[Header], bytes, bytes]:
    """(record headers, HTTP header bytes, payload) as they are written.

    Digests that are there stay, even if the headers are written in other bytes than they were read;
    missing ones are added. A record of unknown length gets all of them, its length and type anew.
    """
    headers: list[Header] = list(row["rec_headers"] or [])
    payload: bytes = row.get("payload") or b""
    rec_type = row.get("rec_type")
    http = None
    if row.get("http_headers") is not None and (row.get("http_statusline") or row["http_headers"]):
        http = Block(row.get("http_protocol") or "", row.get("http_statusline") or "", list(row["http_headers"]))
    head = ascii_bytes(http, keep) if http else b""
    length = row.get("length")
    payload_length = row.get("payload_length", -1)
    if length is None:
        for name in ("WARC-Block-Digest", *(() if rec_type == "revisit" else ("WARC-Payload-Digest",)), "Content-Type"):
            headers = removed(headers, name)
        payload_length = length = len(payload)
    if not get(headers, "WARC-Payload-Digest") and rec_type not in NO_PAYLOAD_DIGEST:
        headers = [*headers, ("WARC-Payload-Digest", digest_of(payload))]
    if not get(headers, "WARC-Block-Digest"):
        headers = [*headers, ("WARC-Block-Digest", digest_of(head + payload))]
    if row.get("content_type") is not None:
        headers = replaced(headers, "Content-Type", row["content_type"])
    body = b"" if rec_type == "revisit" else payload
    if http and payload_length is not None and payload_length >= 0:
        length = len(head) + (0 if rec_type == "revisit" else payload_length)
    headers = replaced(headers, "Content-Length", str(length))
    return headers, head, body


def serialized(row: dict[str, Any], keep: Callable[[Header], Header | None] | None = None) -> bytes:
    """A record as it stands in a plain file."""
    headers, head, body = finished(row, keep)
    block = Block(row.get("rec_protocol") or "WARC/1.0", "", headers)
    return text_of(block).encode("utf-8") + b"\r\n" + head + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 9) -> bytes:
    """data as one gzip member, the same bytes for the same data."""
    tool = zlib.compressobj(level, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()
