"""Pages: response records as text lines. Shared by the page operators.

A page is a response record with a non-empty payload whose Content-Type header is text/html or
missing. The Spark side picks the few header values it needs with higher-order functions, so that
only the payload, four short strings and the keys cross into the Python workers.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.codec.http import decode_content

CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^>]*>")
SCRIPT = re.compile(r"<script\b.*?(?:</script\s*>|\Z)", re.I | re.S)
CODE = re.compile(r"<code\b.*?(?:</code\s*>|\Z)", re.I | re.S)
BODY = re.compile(r"<body\b", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
#: Bytes in which a page may declare its charset.
DECLARED_WITHIN = 4096


def header(headers: Column | str, name: str) -> Column:
    """First value of a header, in any case of its name; null if absent."""
    low = name.lower()
    return F.get(F.filter(F.col(headers) if isinstance(headers, str) else headers, lambda h: F.lower(h["name"]) == low), F.lit(0))["value"]


def site_of(uri: Column) -> Column:
    """Host in lower case without <>, user, port and leading www.; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(uri), r"^<?\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:>\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def page_records(records: DataFrame, *keep: str | Column) -> DataFrame:
    """record_seq, site, content type and codings and payload of all pages, with the columns in keep."""
    workspace.small_batches(records.sparkSession)
    kind = header("http_headers", "Content-Type")
    mime = F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))))
    return records.filter((F.col("rec_type") == "response") & (F.length("payload") > 0) & (kind.isNull() | (mime == "") | (mime == "text/html"))).select(
        "record_seq",
        *keep,
        site_of(header("rec_headers", "WARC-Target-URI")).alias("site"),
        kind.alias("ctype"),
        header("http_headers", "Transfer-Encoding").alias("te"),
        header("http_headers", "Content-Encoding").alias("ce"),
        "payload",
    )


@lru_cache(256)
def _codec(name: str) -> str | None:
    try:
        return codecs.lookup(name).name
    except (LookupError, ValueError):
        return None


def page_bytes(payload: bytes, ctype: str | None, te: str | None, ce: str | None) -> tuple[bytes, str]:
    """(bytes of a page with codings undone, the codec of the header's charset, else its own, else UTF-8)."""
    data, _ = decode_content(payload, te and te.strip().lower(), ce and ce.strip())
    found = CHARSET.search(ctype) if ctype else None
    name = found.group(1) if found else None
    if name is None and (own := META.search(data, 0, DECLARED_WITHIN)):
        name = own.group(1).decode("ascii")
    return data, _codec(name or "utf-8") or "utf-8"


def read_as(data: bytes, codec: str) -> str:
    """Text of bytes, with replacement marks where they can't be read."""
    try:
        return data.decode(codec, "replace")
    except LookupError:  # a codec that does not make text
        return data.decode("utf-8", "replace")


def page_text(payload: bytes, ctype: str | None, te: str | None, ce: str | None) -> str:
    """Content of a page."""
    return read_as(*page_bytes(payload, ctype, te, ce))


def _blank(match: re.Match) -> str:
    """A blank, and the line ends that the match covers."""
    return " " + "\n" * match.group(0).count("\n")


def raw_lines(content: str) -> Iterator[tuple[int, str]]:
    """(line_no, markup) of the lines after that with <body; script elements are blanked out."""
    at = BODY.search(content)
    start = at.start() if at else 0
    first = content.count("\n", 0, start) + 1
    rest = content[start:]
    if "<script" in rest or "<SCRIPT" in rest or "<Script" in rest:
        rest = SCRIPT.sub(_blank, rest)
    if "<!--" in rest:
        rest = COMMENT.sub(_blank, rest)
    lines = enumerate(rest.split("\n"), first)
    if at:
        next(lines)
    for k, line in lines:
        if line:
            yield k, line


def line_text(line: str) -> str:
    """The text of one line."""
    if "<" in line:
        line = TAG.sub(" ", line)
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


def text_lines(content: str) -> list[tuple[int, str]]:
    """(line_no, text) of the lines with text."""
    return [(k, t) for k, line in raw_lines(content) if (t := line_text(line))]


def columns(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def contents(batch) -> Iterator[str]:
    """Content of each page of an Arrow batch."""
    for row in columns(batch, "payload", "ctype", "te", "ce"):
        yield page_text(*row)
