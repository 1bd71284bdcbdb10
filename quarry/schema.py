"""The archive row schema."""

from __future__ import annotations

HEADERS = "array<struct<name: string, value: string>>"
RECORDS = (
    "record_id_seq bigint, path string, filename string, format string, rec_type string, rec_protocol string, "
    f"rec_headers {HEADERS}, http_protocol string, http_statusline string, http_headers {HEADERS}, content_type string, "
    "length bigint, payload_length bigint, payload binary, offset bigint, record_length bigint, "
    "digest struct<passed: boolean, problems: array<string>>, warnings array<string>, error string"
)
COLUMNS = tuple(
    "record_id_seq path filename format rec_type rec_protocol rec_headers http_protocol http_statusline http_headers content_type length payload_length payload offset record_length digest warnings error".split()
)
