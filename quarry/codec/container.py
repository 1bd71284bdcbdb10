"""Framing of archive containers: plain files and files of one gzip member for each record (worker code).

A reader hands out lines and bytes of the current stretch: of a plain file that is all of it, of a
compressed one the current member. Records are framed by their declared length; what lies between
them is blank lines, or one line too many that is reported and skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple

from quarry.codec.digest import verdict
from quarry.codec.headers import HTTP_VERBS, HTTP_VERSIONS, WARC_VERSIONS, BadFirstLine, Block, Header, decode_line, get, new_id, parse_block, replaced

BLOCK = 1 << 20
ARC_FIELDS = ("uri", "ip-address", "archive-date", "content-type", "length")
#: ARC fields as record headers.
ARC_AS_WARC = ("WARC-Target-URI", "WARC-IP-Address", "WARC-Date", "Content-Type", "Content-Length")
WITH_HTTP = ("response", "request", "revisit")


class ArchiveError(Exception):
    """The container can't be read on."""


class Options(NamedTuple):
    """How records are read; the names are those of the data source's options."""

    format: str | None = None
    parse_http: bool = True
    verify_http: bool = False
    arc2warc: bool = False
    ensure_http_headers: bool = False
    check_digests: bool = False
    payload: bool = True
    all_members: bool = False
    max_payload: int = 1 << 30


class Plain:
    """Bytes of a file as they are."""

    compressed = False

    def __init__(self, file: BinaryIO, start: int, data: bytes = b"") -> None:
        self.file, self.data, self.at, self.base = file, data, 0, start

    def tell(self) -> int:
        """Offset in the file of the next byte to hand out."""
        return self.base + self.at

    def _more(self) -> bool:
        new = self.file.read(BLOCK)
        if not new:
            return False
        self.base += self.at
        self.data, self.at = self.data[self.at :] + new, 0
        return True

    def readline(self) -> bytes:
        look = self.at
        while True:
            end = self.data.find(b"\n", look)
            if end >= 0:
                line = self.data[self.at : end + 1]
                self.at = end + 1
                return line
            look = len(self.data)
            behind = look - self.at
            if not self._more():
                line = self.data[self.at :]
                self.at = len(self.data)
                return line
            look = behind

    def read(self, n: int | None) -> bytes:
        """n bytes, or all if n is None; fewer at the end."""
        parts, left = [], n
        while left is None or left > 0:
            piece = self.data[self.at :] if left is None else self.data[self.at : self.at + left]
            if not piece:
                self.base, self.data, self.at = self.tell(), self.file.read(BLOCK), 0
                if not self.data:
                    break
                continue
            parts.append(piece)
            self.at += len(piece)
            if left is not None:
                left -= len(piece)
        return b"".join(parts)


class Members(Plain):
    """Bytes of one gzip member after the other; data that is cut or broken ends its member."""

    compressed = True

    def __init__(self, file: BinaryIO, start: int, data: bytes, joined: bool = False) -> None:
        super().__init__(_Inflating(file, start, data, joined), 0)
        self.member = start

    def tell(self) -> int:
        return self.file.end

    def next_member(self) -> bool:
        """Go to the next member; what is left of this one is passed over."""
        while self.file.read(BLOCK):
            pass
        self.data, self.at, self.base = b"", 0, 0
        self.member = self.file.end
        return self.file.again()


class _Inflating:
    def __init__(self, file: BinaryIO, start: int, data: bytes, joined: bool) -> None:
        self.file, self.raw, self.joined = file, data, joined
        self.end = start
        self.tool = zlib.decompressobj(31)
        self.done = False

    def read(self, _: int) -> bytes:
        while not self.done:
            if not self.raw:
                self.raw = self.file.read(BLOCK)
                if not self.raw:
                    self.done = True
                    break
            try:
                out = self.tool.decompress(self.raw)
            except zlib.error:
                self.end += len(self.raw)
                self.raw, self.done = b"", True
                break
            rest = self.tool.unused_data
            self.end += len(self.raw) - len(rest)
            self.raw = rest
            if self.tool.eof:
                self.done = not (self.joined and self.again())
            if out:
                return out
        return b""

    def again(self) -> bool:
        """Begin the next member, if there is more."""
        if not self.raw:
            self.raw = self.file.read(BLOCK)
        if not self.raw:
            return False
        self.tool, self.done = zlib.decompressobj(31), False
        return True


def opened(file: BinaryIO, start: int, joined: bool = False) -> Plain:
    """A reader of a file from its current place on; compressed if it starts like a gzip member that can be read."""
    head = file.read(BLOCK)
    if head[:2] == b"\x1f\x8b":
        try:
            zlib.decompressobj(31).decompress(head, 1)
            return Members(file, start, head, joined)
        except zlib.error:
            pass
    return Plain(file, start, head)


def read_records(file: BinaryIO, options: Options = Options(), start: int = 0, limit: int | None = None, ids: Any = new_id) -> Iterator[dict[str, Any]]:
    """Rows of the records from the current place on, which is the offset ``start`` of the file.

    A row with ``error`` has no other fields of a record; where nothing can be read on, it is the
    last one. The caller decides whether to raise. Rows come
    one by one, with at most one payload in memory.
    """
    reader = opened(file, start, options.all_members)
    known = options.format
    seq = 0
    line: bytes | None = None
    offset = start
    crowded = False
    while limit is None or seq < limit:
        row: dict[str, Any] | None = None
        try:
            row, known = _record(reader, line, known, options, ids)
            if crowded:
                raise ArchiveError(_crowded(known))
        except EOFError:
            row = None
        except ArchiveError as e:
            yield {"record_id_seq": seq, "offset": offset, "error": str(e)}
            return
        if row is None and not reader.compressed:
            return
        warnings: list[str] = []
        line, blank = _between(reader, warnings)
        if reader.compressed:
            if line is None:
                more = reader.next_member()
                end = reader.member
            else:
                more, end = None, reader.tell()
        else:
            end = reader.tell() - len(line or b"")
        if row is not None:
            length = end - offset if reader.compressed else end - offset - blank
            yield {"error": None} | row | {"record_id_seq": seq, "offset": offset, "record_length": length, "warnings": warnings}
            seq += 1
        if reader.compressed:
            if line is None:
                if not more:
                    return
            else:
                crowded = not options.all_members
        offset = end
        if line is None and not reader.compressed:
            return


def _crowded(known: str | None) -> str:
    kind = known or "warc/arc"
    return f"one gzip member holds several {kind} records: recompress the file, so that each has a member of its own"


def _between(reader: Plain, warnings: list[str]) -> tuple[bytes | None, int]:
    """(the line the next record starts with, bytes of the blank lines before it)."""
    blank, first = 0, True
    while True:
        line = reader.readline()
        if not line:
            return None, blank
        if line.strip() and not first:
            return line, blank
        if line.strip():
            warnings.append("no empty line after the record")
        blank += len(line)
        first = False


def _record(reader: Plain, line: bytes | None, known: str | None, options: Options, ids: Any) -> tuple[dict[str, Any], str | None]:
    block, form, two_lines = _top(reader, line, known, options, ids)
    headers = block.headers
    if form == "arc":
        uri, declared, content_type = get(headers, "uri"), get(headers, "length"), get(headers, "content-type")
        rec_type = "arc_header" if (uri or "").startswith("filedesc://") else "response"
    else:
        rec_type, declared, content_type = get(headers, "WARC-Type"), get(headers, "Content-Length"), get(headers, "Content-Type")
        uri = get(headers, "WARC-Target-URI")
        fixed = repaired_uri(uri)
        if fixed != uri:
            headers, uri = replaced(headers, "WARC-Target-URI", fixed), fixed
    length: int | None = None
    if declared is not None:
        try:
            length = max(int(declared) - two_lines, 0)
        except ValueError:
            length = 0
    body = reader.read(length)
    complete = length is not None and len(body) == length
    http: Block | None = None
    at = 0
    if options.parse_http and length != 0 and rec_type in WITH_HTTP:
        if uri is None:
            return {"error": f"{rec_type} record without WARC-Target-URI"}, form
        if uri.startswith(("http:", "https:")):
            lines = _Lines(body)
            words = (HTTP_VERBS if rec_type == "request" else HTTP_VERSIONS) if options.verify_http else None
            try:
                http = parse_block(lines.readline, words)
                at = lines.at
            except EOFError:
                if rec_type != "revisit":
                    raise
            except BadFirstLine as e:
                raise ArchiveError(str(e)) from None
    payload_length = length - at if length and http else -1
    if not http and options.ensure_http_headers:
        sized = [("Content-Length", str(length))] if length is not None else []
        http = Block("HTTP/1.0", "200 OK", ([("Content-Type", content_type)] if content_type else []) + sized)
    digest = None
    if options.check_digests:
        declared_ = get(headers, "WARC-Block-Digest"), get(headers, "WARC-Payload-Digest")
        digest = verdict(body, body[at:], *declared_, rec_type, get(headers, "WARC-Segment-Number"), complete) if any(declared_) and length is not None else (None, [])
    payload = body[at:] if at else body
    if len(payload) > options.max_payload:
        return {"error": f"payload of {len(payload)} bytes is larger than max_payload"}, form
    return {
        "format": "warc" if form == "arc2warc" else form,
        "rec_type": rec_type,
        "rec_protocol": block.protocol,
        "rec_headers": headers,
        "http_protocol": http.protocol if http else None,
        "http_statusline": http.statusline if http else None,
        "http_headers": http.headers if http else None,
        "content_type": content_type,
        "length": length,
        "payload_length": payload_length,
        "payload": payload if options.payload else None,
        "digest": digest,
    }, form if not options.arc2warc else known


class _Lines:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def readline(self) -> bytes:
        end = self.data.find(b"\n", self.at)
        line = self.data[self.at :] if end < 0 else self.data[self.at : end + 1]
        self.at += len(line)
        return line


def _top(reader: Plain, line: bytes | None, known: str | None, options: Options, ids: Any) -> tuple[Block, str, int]:
    """(record headers, form, characters of the lines an ARC file header counts in its length)."""
    first: bytes | str | None = line
    if known != "arc":
        try:
            return parse_block(reader.readline, WARC_VERSIONS, line), "warc", 0
        except BadFirstLine as e:
            if known == "warc":
                raise ArchiveError(f"Invalid WARC record, first line: {e.line}") from None
            first = e.line
    text = decode_line(reader.readline() if first is None else first)
    if not text:
        raise EOFError
    top = text.rstrip()
    extra = 0
    if top.startswith("filedesc://"):
        extra = len(decode_line(reader.readline())) + len(decode_line(reader.readline()))
    parts = top.rsplit(" ", len(ARC_FIELDS) - 1)
    if len(parts) != len(ARC_FIELDS):
        raise ArchiveError(f"{'Invalid ARC record' if known == 'arc' else 'Unknown archive format'}, first line: {parts}")
    if not options.arc2warc:
        return Block("WARC/1.0", "", list(zip(ARC_FIELDS, parts))), "arc", extra
    return Block("WARC/1.0", "", arc_as_warc(parts, ids)), "arc2warc", extra


def arc_as_warc(parts: list[str], ids: Any = new_id) -> list[Header]:
    """Record headers for the five fields of an ARC record."""
    from quarry.codec.dates import timestamp_to_iso_date

    info = parts[0].startswith("filedesc://")
    out = [("WARC-Type", "warcinfo" if info else "response"), ("WARC-Record-ID", ids(" ".join(parts)) if ids is not new_id else new_id())]
    for name, value in zip(ARC_AS_WARC, parts):
        if name == "WARC-Target-URI" and info:
            name, value = "WARC-Filename", value[len("filedesc://") :]
        elif name == "WARC-Date":
            value = timestamp_to_iso_date(value)
        elif name == "Content-Type" and not info:
            value = "application/http;msgtype=response"
        out.append((name, value))
    return out


def repaired_uri(uri: str | None) -> str | None:
    """Without enclosing <>, blanks as %20."""
    if uri is None:
        return None
    if uri.startswith("<") and uri.endswith(">"):
        uri = uri[1:-1]
    return uri.replace(" ", "%20")
