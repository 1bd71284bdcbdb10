"""Column functions against the worker code and known values."""

from __future__ import annotations

import datetime as dt
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from quarry.codec import digest as codec_digest
from quarry.codec import headers as codec_headers
from quarry.codec.dates import timestamp_to_iso_date
from quarry.functions import dates as D
from quarry.functions import headers as H
from quarry.functions import uris as U
from quarry.functions.content import with_content
from quarry.functions.digests import digest_matches, digest_of
from quarry.schema import HEADERS

BLOCKS = [
    [("A", "1"), ("b", "2"), ("a", "3")],
    [],
    None,
    [("Set-Cookie", "x"), ("Set-Cookie", "y")],
    [("a", "")],
]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(k, None if b is None else [{"name": n, "value": v} for n, v in b]) for k, b in enumerate(BLOCKS)]
    return spark.createDataFrame(rows, f"k int, h {HEADERS}")


def _pairs(h):
    return None if h is None else [(x["name"], x["value"]) for x in h]


@pytest.mark.parametrize("name", ["A", "set-cookie", "zz"])
def test_multimap(blocks, name):
    got = blocks.select(
        "k", H.get_header("h", name).alias("get"), H.replace_header("h", name, "new").alias("rep"), H.remove_header("h", name).alias("rem"), H.add_header("h", name, "z").alias("add"), H.has_header("h", name).alias("has")
    ).collect()
    for r in got:
        own = BLOCKS[r.k] or []
        assert r.get == codec_headers.get(own, name)
        assert _pairs(r.rep) == codec_headers.replaced(own, name, "new")
        assert _pairs(r.rem) == codec_headers.removed(own, name)
        assert _pairs(r.add) == [*own, (name, "z")]
        assert r.has == bool(codec_headers.get(own, name))


def test_block_text_and_parse(spark):
    texts = ["HTTP/1.1 200 OK\r\nA: 1\r\nB:2\r\n  more\r\nnone\r\n gone\r\n\r\nC: 3\r\n", "\r\n", "GET / HTTP/1.0\r\n\r\n", "HTTP/1.0\r\nX-Y : z \r\n\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.parse_block("t").alias("b")).collect()
    import io

    for r in rows:
        own = codec_headers.parse_block(io.BytesIO(r.t.encode()).readline, None)
        assert (r.b.protocol, r.b.statusline, _pairs(r.b.headers)) == (own.protocol, own.statusline, own.headers)
    got = spark.range(1).select(H.block_text(F.lit("HTTP/1.0"), F.lit(""), F.array(H.header("a", "b"))).alias("t"), H.block_bytes(F.lit(""), F.lit(""), F.array().cast(HEADERS)).alias("e")).first()
    assert got.t == "HTTP/1.0\r\na: b\r\n" and bytes(got.e) == b"\r\n"


def test_status_and_range(spark):
    r = spark.createDataFrame([("200 OK",), ("",), ("-1 x",), ("abc",)], "s string")
    assert [x.v for x in r.select(H.valid_statusline("s", "500 No").alias("v")).collect()] == ["200 OK", "500 No", "500 No", "500 No"]
    got = spark.range(1).select(H.add_range(F.array().cast(HEADERS), 10, 4, 100).alias("r")).first().r
    assert got.statusline == "206 Partial Content" and _pairs(got.headers) == [("Content-Range", "bytes 10-13/100"), ("Content-Length", "4"), ("Accept-Ranges", "bytes")]


def test_decode_header(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),), (bytearray(b"a"),)], "b binary")
    assert [r.t for r in rows.select(H.decode_header("b").alias("t")).collect()] == ["é", "é", "a"]


def test_digests(spark):
    data = [b"", b"a", b"some longer bytes", bytes(range(256))]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "d binary")
    import base64
    import hashlib

    for algorithm in ("sha1", "md5", "sha256", "sha512"):
        got = [r.x for r in rows.select(digest_of("d", algorithm).alias("x")).collect()]
        assert got == [codec_digest.digest_of(d, algorithm) for d in data]
        forms = [(x, bytearray(d)) for x, d in zip(got, data)] + [(f"{algorithm}:{hashlib.new(algorithm, d).hexdigest().upper()}", bytearray(d)) for d in data]
        forms += [(f"{algorithm}:" + base64.urlsafe_b64encode(hashlib.new(algorithm, d).digest()).decode(), bytearray(d)) for d in data]
        forms += [(got[0], bytearray(b"other")), ("nope:AA", bytearray(b"a")), ("plain", bytearray(b"a")), (None, bytearray(b"a"))]
        checked = spark.createDataFrame(forms, "x string, d binary").select(digest_matches("x", "d").alias("ok")).collect()
        of_hex = algorithm != "md5"  # where base 32 with its padding is as long as hexadecimal, and is what it is taken for
        assert [r.ok for r in checked] == [True] * 4 + [of_hex] * 4 + [True] * 4 + [False, None, None, None]


ISO = ["2013-12-26T10:11:12Z", "2013-12-26T10:11:12.456789Z", "2013-12-26T10:11:12.30Z", "2013-12-26T10:11:12.0000001Z", "2013-12-26", "bad", "2013-13-01T00:00:00Z", None]


def test_iso(spark):
    got = [r.t for r in spark.createDataFrame([(s,) for s in ISO], "s string").select(D.iso_to_time("s").alias("t")).collect()]
    t = dt.datetime(2013, 12, 26, 10, 11, 12)
    assert got == [t, t.replace(microsecond=456789), t.replace(microsecond=300000), t, dt.datetime(2013, 12, 26), None, None, None]


def test_http_dates(spark):
    texts = ["Thu, 26 Dec 2013 09:50:10 GMT", "26 Dec 2013 09:50:10", "Thursday, 26-Dec-13 09:50:10 GMT", "nonsense", None]
    got = spark.createDataFrame([(s,) for s in texts], "s string").select(D.http_to_time("s").alias("t"), D.http_to_timestamp("s").alias("n")).collect()
    assert [r.t for r in got] == [dt.datetime(2013, 12, 26, 9, 50, 10)] * 3 + [None, None] and got[0].n == "20131226095010"


def test_timestamps(spark):
    stamps = ["20141226095010", "2014122609501011", "2014122609501", "201412260", "2014122", "201410", "20141", "201", "20", "2", "3", "", "20131709005601", "40001965252477", "2010abc", "20120230", None]
    got = spark.createDataFrame([(s,) for s in stamps], "s string").select("s", D.timestamp_to_iso("s").alias("iso"), D.timestamp_to_http("s").alias("http"), D.timestamp_to_seconds("s").alias("sec"), D.pad_timestamp("s").alias("pad")).collect()
    for r in got:
        if r.s is None:
            assert r.iso is None
            continue
        assert r.iso == timestamp_to_iso_date(r.s)
        when = dt.datetime.strptime(r.iso, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc)
        assert r.sec == int(when.timestamp()) and r.http == when.strftime("%a, %d %b %Y %H:%M:%S GMT")
    assert got[8].pad == "209912"
    one = spark.range(1).select(D.seconds_to_timestamp(F.lit(1388051410)).alias("a"), D.time_to_iso(F.expr("timestamp_ntz'2013-12-26 10:11:12.000001'"), True).alias("b"), F.length(D.timestamp20_now()).alias("n"), F.length(D.timestamp_now()).alias("m")).first()
    assert (one.a, one.b, one.n, one.m) == ("20131226095010", "2013-12-26T10:11:12.000001Z", 20, 14)


def test_uris(spark):
    texts = ["abc/ü é~*+&=%", "plain", "emoji 😀", "", None]
    got = [r.q for r in spark.createDataFrame([(s,) for s in texts], "s string").select(U.percent_quoted("s").alias("q")).collect()]
    assert got == [None if s is None else quote(s) for s in texts]
    uris = ["<http://a/ b>", "<http://a", "http://a", "<", None]
    assert [r.u for r in spark.createDataFrame([(s,) for s in uris], "s string").select(U.repaired_uri("s").alias("u")).collect()] == ["http://a/%20b", "<http://a", "http://a", "<", None]
    rows = spark.createDataFrame([("GET", "/p", "h", 80, 80), ("GET", "/p", "h", 8443, 443), ("GET", "http://o/x", "proxy", 3128, 80), ("CONNECT", "o:443", "proxy", 3128, 80)], "v string, t string, h string, p int, d int")
    got = rows.select(U.request_url("t", "h", "p", "d", "v").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("http://h/p", None), ("https://h:8443/p", None), ("http://o/x", "http://proxy:3128"), (None, "https://proxy:3128")]
    through = spark.createDataFrame([("GET", "/p", "proxy", 3128, 443, "o:443"), ("GET", "/p", "proxy", 3128, 443, "o:8443"), ("GET", "/p", "proxy", 3128, 443, "o"), ("GET", "/p", "h", 443, 443, None)], "v string, t string, h string, p int, d int, c string")
    got = through.select(U.request_url("t", "h", "p", "d", "v", "c").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("https://o/p", "https://proxy:3128"), ("https://o:8443/p", "https://proxy:3128"), ("https://o/p", "https://proxy:3128"), ("https://h/p", None)]


def test_content_columns(spark):
    import gzip

    rows = [(1, [("Content-Encoding", "GZIP")], gzip.compress(b"x")), (2, None, b"y"), (3, [("transfer-encoding", "chunked")], b"1\r\nz\r\n0\r\n\r\n"), (4, [], None), (5, [("Content-Encoding", "gzip")], b"not gzip")]
    data = [(k, None if h is None else [{"name": n, "value": v} for n, v in h], None if p is None else bytearray(p), "extra") for k, h, p in rows]
    got = with_content(spark.createDataFrame(data, f"k int, http_headers {HEADERS}, payload binary, content_type string")).orderBy("k").collect()
    assert [None if r.content is None else bytes(r.content) for r in got] == [b"x", b"y", b"z", None, b"not gzip"]
