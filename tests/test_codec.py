"""Worker code: content codings, header blocks, digests, framing."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.codec import digest, headers
from quarry.codec.container import ArchiveError, Options, read_records, repaired_uri
from quarry.codec.dates import timestamp_to_iso_date
from quarry.codec.http import ChunkError, chunks, decode_content, inflate
from quarry.codec.serialize import gzip_member, serialized

# -- content -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (b"6\r\nharbor\r\n0\r\n\r\n", b"harbor"),
        (b"A;note=x\r\nten letter\r\n3\r\nsdo\r\n0\r\n\r\n", b"ten lettersdo"),
        (b"no size here\r\nat all", b"no size here\r\nat all"),  # not chunked: as it is
        (b"2\r\nabQQrest", b"2\r\nabrest"),  # no line end after a chunk: the two bytes in its place are lost, the rest passes
        (b"5\r\nwhole\r\n8\r\nhalf", b"wholehalf"),  # ends early
        (b"3\r\none\r\nzz\r\ntwo\r\n", b"onezz\r\ntwo\r\n"),  # a bad size later
        (b"0\r\n\r\n", b""),
        (b"", b""),
    ],
)
def test_chunks(raw, expected):
    assert b"".join(chunks(raw)) == expected


def test_chunks_strict():
    with pytest.raises(ChunkError):
        list(chunks(b"2\r\nabQQ", strict=True))
    with pytest.raises(ChunkError):
        list(chunks(b"7\r\nshort", strict=True))


def _chunked(data: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)) + b"0\r\n\r\n"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 700), st.sampled_from(["none", "gzip", "deflate", "raw"]))
def test_content_round_trip(data, size, kind):
    coded = {"none": data, "gzip": gzip.compress(data), "deflate": zlib.compress(data), "raw": zlib.compress(data)[2:-4]}[kind]
    name = {"none": None, "raw": "deflate"}.get(kind, kind)
    assert decode_content(_chunked(coded, size), "chunked", name)[0] == data
    if name:
        assert decode_content(coded, None, name.upper())[0] == data


def test_content_fallbacks():
    assert decode_content(b"plain", None, "gzip") == (b"plain", None)
    assert decode_content(b"plain", "Chunked", None) == (b"plain", None)
    assert decode_content(b"x", None, "unknown") == (b"x", None)
    assert decode_content(None, "chunked", "gzip") == (None, None)
    two = gzip.compress(b"a") + gzip.compress(b"b")
    assert decode_content(two, None, "gzip")[0] == b"a"
    assert decode_content(two, None, "gzip", all_members=True)[0] == b"ab"
    broken = bytearray(gzip.compress(hashlib.sha512(b"x").digest() * 4000))
    broken[40:60] = b"\xff" * 20
    decode_content(bytes(broken), None, "gzip")  # ends early or passes as it is, but does not raise
    with pytest.raises(ValueError, match="unknown content coding"):
        inflate(iter([b""]), "zip")


# -- headers -------------------------------------------------------------------------------------


def _block(text: bytes, words=None):
    return headers.parse_block(io.BytesIO(text).readline, words)


def test_header_grammar():
    b = _block(b"HTTP/1.0 200 OK\r\nA: 1\r\nB : 2  \r\n\tmore\r\nno colon\r\n dropped\r\nC:3\r\n\r\nrest")
    assert (b.protocol, b.statusline) == ("HTTP/1.0", "200 OK")
    assert b.headers == [("A", "1"), ("B", "2\tmore"), ("C", "3")]
    assert _block(b"\r\n") == headers.Block("", "", [], 2)
    with pytest.raises(EOFError):
        _block(b"")
    with pytest.raises(headers.BadFirstLine):
        _block(b"NOPE 1\r\n\r\n", headers.HTTP_VERSIONS)
    assert _block(b"http/1.1 204\r\n\r\n", headers.HTTP_VERSIONS).protocol == "HTTP/1.1"
    assert _block("X: ö\r\n\r\n".encode("latin-1") + b"\r\n").protocol == "X:"


def test_header_multimap():
    h = [("A", "1"), ("b", "2"), ("a", "3")]
    assert headers.get(h, "a") == "1" and headers.get(h, "zz", "d") == "d" and headers.get(None, "a") is None
    assert headers.replaced(h, "A", "9") == [("A", "1"), ("b", "2"), ("a", "9")]
    assert headers.replaced(h, "C", "4")[-1] == ("C", "4")
    assert headers.removed(h, "A") == h[:2] and headers.removed(h, "x") == h


def test_header_encoding():
    assert headers.encode_value("plain; a=b") == "plain; a=b"
    assert headers.as_text({b"A": "b", "C": b"\xe9"}) == [("A", "b"), ("C", "é")] and headers.as_text([(b"x", b"y")]) == [("x", "y")]
    assert headers.encode_value("/é ü") == "/%C3%A9%20%C3%BC"
    assert headers.encode_value('attachment; filename="é"') == "attachment; filename*=UTF-8''%C3%A9"
    assert headers.encode_value('inline; name=a; filename="é;ü"; x') == "inline; name*=UTF-8''a; filename*=UTF-8''%C3%A9%3B%C3%BC; x"
    assert headers.encode_value("é; flag") == "%C3%A9%3B%20flag"
    block = headers.Block("HTTP/1.0", "200 OK", [("A", "é"), ("B", "x")])
    assert headers.ascii_bytes(block, lambda h: None if h[0] == "B" else h) == b"HTTP/1.0 200 OK\r\nA: %C3%A9\r\n\r\n"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"\A[A-Za-z-]{1,12}\Z"), st.from_regex(r"\A[!-~][ -~]{0,20}[!-~]\Z")), max_size=6))
def test_header_round_trip(pairs):
    block = headers.Block("WARC/1.0", "", pairs)
    assert _block(headers.text_of(block).encode() + b"\r\n", headers.WARC_VERSIONS).headers == pairs


# -- digests -------------------------------------------------------------------------------------


def test_digest_encodings():
    data = b"some bytes"
    raw = hashlib.sha1(data).digest()
    forms = [base64.b32encode(raw), base64.b64encode(raw), base64.urlsafe_b64encode(raw), raw.hex().encode(), raw.hex().upper().encode()]
    assert all(digest.matches("sha1:" + f.decode(), data) for f in forms)
    assert digest.matches("sha1:" + base64.b32encode(raw).decode().lower(), data) is False
    assert digest.matches("nope:abc", data) is None and digest.matches("abc", data) is None
    assert digest.digest_of(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_verdict():
    good, bad = digest.digest_of(b"ab"), digest.digest_of(b"x")
    assert digest.verdict(b"ab", b"b", good, digest.digest_of(b"b"), "response") == (True, [])
    assert digest.verdict(b"ab", b"b", good, bad, "response").passed is False
    assert digest.verdict(b"ab", b"b", bad, bad, "revisit") == (None, [])
    assert digest.verdict(b"ab", b"b", None, bad, "response", segment="1") == (None, [])
    assert digest.verdict(b"ab", b"b", good, None, "response", complete=False) == (None, [])
    assert digest.verdict(b"", b"", bad, None, "response") == (None, [])
    assert digest.verdict(b"", b"", None, bad, "response").problems == [f"payload digest failed: {bad}"]
    assert digest.verdict(b"ab", b"b", None, "zz:1", "response").problems == ["unknown hash algorithm name in payload digest"]


# -- dates, URIs ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("stamp", "iso"),
    [
        ("20141226095010", "2014-12-26T09:50:10Z"),
        ("2014122609501011", "2014-12-26T09:50:10Z"),
        ("2014122", "2014-12-31T23:59:59Z"),
        ("201410", "2014-10-31T23:59:59Z"),
        ("", "2999-12-31T23:59:59Z"),
        ("3", "2999-12-31T23:59:59Z"),
        ("20131709005601", "2013-12-09T00:56:01Z"),
        ("40001965252477", "2999-12-31T23:24:59Z"),
        ("2010abc", "2010-12-31T23:59:59Z"),
    ],
)
def test_timestamps(stamp, iso):
    assert timestamp_to_iso_date(stamp) == iso


def test_uris():
    assert repaired_uri("<http://a/ b>") == "http://a/%20b"
    assert repaired_uri("<http://a") == "<http://a" and repaired_uri(None) is None


# -- framing -------------------------------------------------------------------------------------


def record(kind="response", body=b"HTTP/1.0 200 OK\r\nContent-Type: text/plain\r\n\r\nhello", uri="http://a.example/", length=None, extra=b"", end=b"\r\n\r\n"):
    n = len(body) if length is None else length
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Target-URI: " + uri.encode() + b"\r\n" + extra + b"Content-Length: " + str(n).encode() + b"\r\n\r\n" + body + end


def rows_of(data: bytes, **options):
    return list(read_records(io.BytesIO(data), Options(**options)))


def test_plain_offsets_and_fields():
    a, b = record(), record("metadata", b"x: y")
    rows = rows_of(a + b)
    assert [(r["rec_type"], r["offset"], r["record_length"], r["length"]) for r in rows] == [("response", 0, len(a) - 4, 50), ("metadata", len(a), len(b) - 4, 4)]
    assert rows[0]["http_statusline"] == "200 OK" and rows[0]["payload"] == b"hello" and rows[0]["payload_length"] == 5
    assert rows[1]["http_headers"] is None and rows[1]["payload_length"] == -1 and rows[1]["payload"] == b"x: y"


def test_gzip_members():
    a, b = record(), record("metadata", b"x")
    za, zb = gzip_member(a), gzip_member(b)
    rows = rows_of(za + zb)
    assert [(r["offset"], r["record_length"]) for r in rows] == [(0, len(za)), (len(za), len(zb))]
    again = list(read_records(io.BytesIO(zb), Options(), len(za)))
    assert again[0]["offset"] == len(za)


def test_several_records_in_a_member():
    data = gzip_member(record() + record("metadata", b"x"))
    rows = rows_of(data)
    assert rows[0]["rec_type"] == "response" and len(rows) == 2 and "several" in rows[1]["error"]
    assert [r["rec_type"] for r in rows_of(data, all_members=True)] == ["response", "metadata"]
    cut = gzip.compress(record()[:60]) + gzip.compress(record()[60:] + record("metadata", b"x"))
    assert [r["rec_type"] for r in rows_of(cut, all_members=True)] == ["response", "metadata"]


def test_lengths():
    assert rows_of(record(body=b"", length=-5))[0]["length"] == 0
    assert rows_of(record(body=b"", length="abc"))[0]["length"] == 0
    free = b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nall of it\r\n"
    assert rows_of(free)[0]["length"] is None and rows_of(free)[0]["payload"] == b"all of it\r\n"


def test_wrong_length_is_reported():
    rows = rows_of(record("metadata", b"long body", length=4) + record("metadata", b"x"))
    assert rows[0]["warnings"] == ["no empty line after the record"] and rows[-1]["payload"] == b"x"


def test_errors_are_rows():
    assert rows_of(b"garbage line\r\n")[0]["error"].startswith("Unknown archive format")
    rows = rows_of(record() + b"garbage\r\n\r\n" + b"more garbage\r\n")
    assert rows[0]["error"] is None
    assert "Invalid WARC record" in rows_of(b"nope\r\n", format="warc")[0]["error"]
    missing = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    rows = rows_of(missing + record())
    assert "without WARC-Target-URI" in rows[0]["error"] and rows[1]["payload"] == b"hello"
    assert rows_of(b"") == []


def test_truncated_block_is_not_judged():
    whole = record("resource", b"12345", extra=b"WARC-Payload-Digest: sha1:AAAA\r\n")
    assert rows_of(whole, check_digests=True)[0]["digest"].passed is False
    assert rows_of(whole[:-7], check_digests=True)[0]["digest"].passed is None


def test_arc():
    top = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"HTTP/1.0 200 OK\nA: b\n\nhi"
    data = b"filedesc://f.arc 127.0.0.1 20140216050221 text/plain %d\n%s\nhttp://a/b c 127.0.0.1 20140216050221 text/html %d\n%s\n" % (len(top), top, len(body), body)
    rows = rows_of(data)
    assert [r["rec_type"] for r in rows] == ["arc_header", "response"] and rows[0]["length"] == 0
    assert rows[1]["payload"] == b"hi" and headers.get(rows[1]["rec_headers"], "uri") == "http://a/b c"
    warc = rows_of(data, arc2warc=True)
    assert headers.get(warc[0]["rec_headers"], "WARC-Filename") == "f.arc"
    assert headers.get(warc[1]["rec_headers"], "WARC-Date") == "2014-02-16T05:02:21Z" and warc[1]["format"] == "warc"
    assert "Invalid ARC record" in rows_of(record(), format="arc")[0]["error"]


def test_options():
    data = record()
    assert rows_of(data, parse_http=False)[0]["http_headers"] is None
    assert rows_of(data, payload=False)[0]["payload"] is None
    made = rows_of(record("resource", b"x", extra=b"Content-Type: text/x\r\n"), ensure_http_headers=True)[0]
    assert made["http_headers"] == [("Content-Type", "text/x"), ("Content-Length", "1")]
    assert rows_of(record(body=b"BAD\r\n\r\n"), verify_http=True)[0]["error"]
    assert rows_of(record(uri="dns:a"))[0]["http_headers"] is None
    assert rows_of(data, max_payload=2)[0]["error"].startswith("payload of 5 bytes")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5), st.booleans())
def test_write_read_identity(bodies, compressed):
    made = [
        {"rec_type": "resource", "rec_protocol": "WARC/1.0", "rec_headers": [("WARC-Type", "resource"), ("WARC-Target-URI", f"x:{k}")], "http_headers": None, "content_type": "text/plain", "length": len(b), "payload_length": -1, "payload": b}
        for k, b in enumerate(bodies)
    ]
    data = [serialized(r) for r in made]
    rows = rows_of(b"".join(gzip_member(d) if compressed else d for d in data), check_digests=True)
    assert [r["payload"] for r in rows] == bodies
    assert all(r["digest"].passed for r in rows)
    assert b"".join(serialized(r) for r in rows) == b"".join(data)


def test_serialize_rules():
    base = {"rec_protocol": "WARC/1.0", "http_headers": [("A", "é")], "http_protocol": "HTTP/1.0", "http_statusline": "200 OK", "content_type": "application/http; msgtype=response"}
    response = base | {"rec_type": "response", "rec_headers": [("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:KEPT")], "length": 99, "payload_length": 2, "payload": b"hi"}
    text = serialized(response)
    assert b"WARC-Payload-Digest: sha1:KEPT" in text and b"A: %C3%A9" in text and text.endswith(b"hi\r\n\r\n")
    revisit = serialized(base | {"rec_type": "revisit", "rec_headers": [("WARC-Type", "revisit")], "length": 5, "payload_length": 0, "payload": b"gone"})
    assert b"gone" not in revisit and b"WARC-Payload-Digest" not in revisit
    unknown = serialized({"rec_type": "resource", "rec_headers": [("WARC-Block-Digest", "sha1:OLD"), ("Content-Type", "a/b")], "length": None, "content_type": "a/b", "payload": b"xyz"})
    assert b"sha1:OLD" not in unknown and b"Content-Length: 3" in unknown


def test_archive_error_is_an_exception():
    assert issubclass(ArchiveError, Exception)
