"""The data source and the verbs."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.codec.container import ArchiveError, Options, read_records
from quarry.codec.serialize import gzip_member, serialized
from quarry.functions import headers as H
from quarry.operators import archive as A
from quarry.schema import HEADERS
from quarry.streaming.archives import captures_by_hour, read_stream, write_stream
from tests.test_codec import record


def warc(n: int, compressed: bool = True, start: int = 0) -> bytes:
    parts = [record(uri=f"http://a.example/{k}", body=b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody %d" % k, extra=b"WARC-Record-ID: <urn:uuid:%d>\r\nWARC-Date: 2020-01-01T0%d:00:00Z\r\n" % (k, k % 10)) for k in range(start, start + n)]
    return b"".join(gzip_member(p) if compressed else p for p in parts)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(warc(5))
    (tmp_path / "in" / "b.warc").write_bytes(warc(3, False, 5))
    return tmp_path


def test_read_folder(spark, folder):
    rows = A.read(spark, str(folder / "in")).orderBy("filename", "record_id_seq").collect()
    assert [r.filename for r in rows] == ["a.warc.gz"] * 5 + ["b.warc"] * 3
    assert [bytes(r.payload) for r in rows] == [b"body %d" % k for k in range(8)]
    assert rows[6].offset == rows[5].record_length + 4 and rows[0].http_statusline == "200 OK"
    assert A.read(spark, str(folder / "in" / "*.gz")).count() == 5
    assert A.read(spark, [str(folder / "in" / "b.warc")] * 2).count() == 6


def test_pushdown_and_options(spark, folder):
    rows = A.read(spark, str(folder / "in"), payload="none", parse_http=False)
    offset = rows.filter("filename = 'a.warc.gz'").orderBy("offset").collect()[2].offset
    one = A.read(spark, str(folder / "in")).filter((F.col("filename") == "a.warc.gz") & (F.col("offset") == offset)).collect()
    assert [bytes(r.payload) for r in one] == [b"body 2"]
    got = rows.select("payload", "http_headers").collect()
    assert all(r.payload is None and r.http_headers is None for r in got)


def test_errors(spark, folder):
    (folder / "in" / "bad.warc").write_bytes(b"nothing of use\r\n")
    (folder / "in" / "empty.warc").write_bytes(b"")
    rows = A.read(spark, str(folder / "in"))
    assert rows.filter("error IS NOT NULL").count() == 1 and rows.filter("error IS NULL").count() == 8
    with pytest.raises(Exception, match="Unknown archive format"):
        A.read(spark, str(folder / "in"), mode="failfast").count()
    assert A.exit_code(A.check(rows)) == 1


@pytest.mark.parametrize("compressed", [True, False])
def test_write_and_split_invariance(spark, folder, compressed):
    rows = A.read(spark, str(folder / "in"))
    for name, many in (("one", rows.coalesce(1)), ("many", rows.repartition(4))):
        A.write(many, str(folder / name), compressed)
        got = A.read(spark, str(folder / name), check_digests=True)
        assert sorted(bytes(r.payload) for r in got.collect()) == sorted(b"body %d" % k for k in range(8))
        assert {r.verdict for r in A.check(got).collect()} == {"pass"}
    A.write(rows.limit(0), str(folder / "none"), compressed)
    assert not [f for f in os.listdir(folder / "none") if f.startswith("part")]
    A.write(rows, str(folder / "one"), compressed, mode="overwrite", one_file=True)
    assert [r.record_id_seq for r in A.read(spark, str(folder / "one")).collect()] == list(range(8))


def test_index(spark, folder):
    rows = A.read(spark, str(folder / "in" / "a.warc.gz"))
    indexed = A.index(rows, "offset,filename,http:status,http:content-type,warc-target-uri,zz", names={"warc-target-uri": "uri"})
    lines = [json.loads(r.value) for r in A.index_lines(indexed).collect()]
    assert lines[0] == {"offset": "0", "filename": "a.warc.gz", "http:status": "200", "http:content-type": "text/plain", "uri": "http://a.example/0"}
    assert A.index_lines(indexed).first().value.startswith('{"offset": "0", "filename"')
    assert A.needs_http("offset,http:status") and not A.needs_http(["offset"])


def test_check(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    good = b"WARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N\r\n"
    data = record(body=body, extra=good) + record(body=body, extra=b"WARC-Payload-Digest: sha1:AAAA\r\n") + record("revisit", body, extra=good) + record(body=body) + record(body=body, extra=b"WARC-Block-Digest: what\r\n")
    (tmp_path / "c.warc").write_bytes(data)
    worker = A.check(A.read(spark, str(tmp_path / "c.warc"), check_digests=True, payload="none")).orderBy("offset").collect()
    assert [r.verdict for r in worker] == ["pass", "fail", "revisit", "none", "fail"]
    columns = A.check(A.read(spark, str(tmp_path / "c.warc"))).orderBy("offset").collect()
    assert [r.verdict for r in columns] == ["pass", "fail", "revisit", "none", "unchecked"]
    assert columns[1].problems == worker[1].problems == ["payload digest failed sha1:AAAA"]
    with pytest.raises(Exception, match="digest failed"):
        A.read(spark, str(tmp_path / "c.warc"), check_digests="raise").count()


def test_extract(spark, folder, tmp_path):
    path = str(folder / "in" / "a.warc.gz")
    rows = A.read(spark, path, payload="none").orderBy("offset").collect()
    assert A.extract(path, rows[3].offset, "payload") == b"body 3"
    assert A.extract(path, rows[3].offset).endswith(b"\r\n\r\nbody 3")
    assert A.extract(path, rows[3].offset, "headers").startswith(b"WARC/1.0\r\n")
    with pytest.raises(Exception):
        A.extract(path, rows[3].offset + 5)
    got = A.extract_all(A.read(spark, str(folder / "in"), payload="none").select("path", "offset"))
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted(b"body %d" % k for k in range(8))


def test_recompress(spark, tmp_path):
    whole = tmp_path / "whole.warc.gz"
    whole.write_bytes(gzip.compress(warc(4, False)))
    out = tmp_path / "out.warc.gz"
    assert A.recompress(spark, str(whole), str(out)) == (4, True)
    assert [r["payload"] for r in read_records(io.BytesIO(out.read_bytes()))] == [b"body %d" % k for k in range(4)]
    assert A.recompress(spark, str(out), str(tmp_path / "again.warc.gz")) == (4, False)
    (tmp_path / "bad").write_bytes(b"\x1f\x8bnot at all")
    with pytest.raises(ArchiveError):
        A.recompress(spark, str(tmp_path / "bad"), str(tmp_path / "x"))


def test_build_records(spark):
    rows = spark.createDataFrame([(1, "abc", "extra"), (2, None, "extra")], "k int, body string, _uri string")
    built = A.build_records(rows, F.lit("http://a/"), "resource", F.col("body"), F.lit("2020-01-01T00:00:00Z"), F.col("k"), keep=["k"]).orderBy("k").collect()
    names = [h["name"] for h in built[0].rec_headers]
    assert names == ["WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"]
    assert built[0].content_type == "application/warc-record" and built[1].length == 0
    info = A.build_records(rows, F.lit(""), "warcinfo", A.warcinfo_body([("software", F.lit("x")), ("none", F.lit(None)), ("empty", F.lit(""))]), F.lit("d"), F.col("k"), version="WARC/1.1").first()
    assert [h["name"] for h in info.rec_headers] == ["WARC-Type", "WARC-Record-ID", "WARC-Date"] and bytes(info.payload) == b"software: x\r\n"
    assert info.content_type == "application/warc-fields" and A.version_name("1.1") == "WARC/1.1" and A.version_name(None) == "WARC/1.0"
    given = F.array(H.header("warc-record-id", "mine"), H.header("Content-Type", "a/b"))
    own = A.build_records(rows, F.lit("u:"), "metadata", None, F.lit("d"), F.col("k"), warc_headers=given).first()
    assert H and own.content_type == "a/b" and [h["value"] for h in own.rec_headers][0] == "mine"


def test_revisits(spark):
    rows = spark.createDataFrame([(k, f"body {k % 3}") for k in range(9)] + [(9, None)], "k int, body string")
    built = A.build_records(rows, F.concat(F.lit("http://a/"), "k"), "response", F.col("body"), F.lit("2020-01-01T00:00:00Z"), F.col("k"), keep=["k"])
    done = A.as_revisits(built, ["k"]).orderBy("k").collect()
    assert [r.rec_type for r in done] == ["response"] * 3 + ["revisit"] * 6 + ["response"]
    values = {h["name"]: h["value"] for h in done[4].rec_headers}
    assert values["WARC-Refers-To-Target-URI"] == "http://a/1" and values["WARC-Profile"].endswith("identical-payload-digest") and bytes(done[4].payload) == b""
    got = {r.revisit_id: r.original_id for r in A.resolved_revisits(A.as_revisits(built, ["k"])).collect()}
    ids = {r.k: {h["name"]: h["value"] for h in r.rec_headers}["WARC-Record-ID"] for r in done}
    assert got == {ids[k]: ids[k % 3] for k in range(3, 9)}


def test_pairs_and_exchanges(spark):
    rows = [
        (1, bytearray(b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n"), bytearray(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhi"), "h", 80, 80, "192.0.2.1", dt.datetime(2020, 1, 1)),
        (2, bytearray(b"GET http://o/y HTTP/1.1\r\n\r\nq"), bytearray(b"HTTP/1.1 404 No\r\n\r\n"), "p", 3128, 80, None, dt.datetime(2020, 1, 2)),
    ]
    made = A.exchange_records(spark.createDataFrame(rows, "exchange_id int, request binary, response binary, host string, port int, default_port int, ip string, time timestamp_ntz")).orderBy("exchange_id", "place").collect()
    assert [r.rec_type for r in made] == ["response", "request"] * 2
    first = {h["name"]: h["value"] for h in made[1].rec_headers}
    assert first["WARC-Concurrent-To"] == {h["name"]: h["value"] for h in made[0].rec_headers}["WARC-Record-ID"] and first["WARC-Target-URI"] == "http://h/x"
    assert {h["name"]: h["value"] for h in made[2].rec_headers}["WARC-Proxy-Host"] == "http://p:3128" and bytes(made[0].payload) == b"hi" and bytes(made[3].payload) == b"q"
    frame = spark.createDataFrame(made)
    pairs = A.paired(frame).collect()
    assert len(pairs) == 2 and all(p.response_id for p in pairs)
    data = A.serialized_records(frame.orderBy("exchange_id", "place"), keep=["exchange_id", "place"]).orderBy("exchange_id", "place").collect()
    again = list(read_records(io.BytesIO(b"".join(bytes(r.data) for r in data)), Options(check_digests=True)))
    assert [r["rec_type"] for r in again] == ["response", "request"] * 2 and all(r["digest"].passed for r in again)
    small = A.serialized_records(frame.limit(1), header_filter=lambda h: None if h[0] == "A" else h).first()
    assert b"A: b" not in bytes(small.data)


def test_arc_columns(spark):
    lines = [("filedesc://x.arc 0.0.0.0 2020 text/plain 75",), ("http://a/b c 1.2.3.4 20200102030405 text/html 9",)]
    got = spark.createDataFrame(lines, "l string").select(A.arc_as_warc(A.arc_headers(F.col("l")), F.col("l")).alias("h")).collect()
    a, b = ({h["name"]: h["value"] for h in r.h} for r in got)
    assert a["WARC-Filename"] == "x.arc" and a["WARC-Type"] == "warcinfo" and a["WARC-Date"] == "2020-12-31T23:59:59Z" and a["Content-Type"] == "text/plain"
    assert b["WARC-Target-URI"] == "http://a/b c" and b["Content-Type"] == "application/http;msgtype=response"


def test_streams(spark, folder, tmp_path):
    stream = read_stream(spark, "file://" + str(folder / "in"), 1)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert A.read(spark, str(tmp_path / "out")).count() == 8
    q = captures_by_hour(read_stream(spark, "file://" + str(folder / "in"), 1)).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n, count(*) AS hours FROM hours").first() == (8, 8)
    simple = spark.readStream.format("webarchive").option("payload", "none").load(str(folder / "in"))
    q = simple.writeStream.format("memory").queryName("simple").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM simple").count() == 8


def test_nulls_and_clashing_columns(spark):
    schema = f"record_seq bigint, path string, offset bigint, rec_type string, rec_headers {HEADERS}, http_headers {HEADERS}, http_statusline string, record_length bigint, length bigint, payload binary, digest struct<passed: boolean, problems: array<string>>, error string, warnings array<string>, _digest string"
    rows = spark.createDataFrame([tuple([None] * 14), (1, "p", 0, "response", None, [], "", 5, None, None, None, None, [], "x")], schema)
    assert A.index(rows, "offset,length,filename,http:status,http:a,b").count() == 2
    assert [r.verdict for r in A.check(rows).collect()] == ["none", "none"]
    assert A.as_revisits(rows.drop("_digest"), ["record_seq"]).count() == 2 and A.paired(rows).count() == 0 and A.resolved_revisits(rows).count() == 0
    assert A.check(rows.limit(0)).count() == 0


def test_command_line(spark, folder, capsysbinary, tmp_path):
    path = str(folder / "in" / "a.warc.gz")
    assert main(["extract", path, "0", "--payload"]) == 0
    assert capsysbinary.readouterr().out == b"body 0"
    assert main(["index", path, "-f", "offset,warc-type", "-o", str(tmp_path / "i")]) == 0
    assert (tmp_path / "i").read_text().splitlines()[0] == '{"offset": "0", "warc-type": "response"}'
    assert main(["index", path, path, "-f", "offset,warc-type", "--folder", str(tmp_path / "lines")]) == 0
    assert spark.read.text(str(tmp_path / "lines")).count() == 10
    assert main(["check", path, "-v"]) == 0
    assert b"no digest to check" in capsysbinary.readouterr().out
    assert main(["recompress", path, str(tmp_path / "r.warc.gz")]) == 0
    assert b"No Errors Found!" in capsysbinary.readouterr().out
    row = next(read_records(io.BytesIO((tmp_path / "r.warc.gz").read_bytes())))
    assert serialized(row).startswith(b"WARC/1.0\r\nWARC-Type: response")


def test_bytes_in_a_table(spark, folder):
    """Archives as rows of bytes, as they come from file systems the workers can't open themselves."""
    from quarry.streaming.archives import parsed_files

    files = spark.read.format("binaryFile").load("file://" + str(folder / "in"))
    rows = parsed_files(files, payload="none")
    assert rows.count() == 8 and rows.filter("payload IS NOT NULL").count() == 0


def test_pushdown_reaches_the_plan(spark, folder):
    plan = A.read(spark, str(folder / "in")).filter("offset = 0")._jdf.queryExecution().executedPlan().toString()
    assert "webarchive" in plan


def test_workspace(spark):
    from quarry import workspace

    df, counts = workspace.observed(spark.range(10), "x", n=F.count(F.lit(1)), top=F.max("id"))
    assert df.count() == 10 and counts == {"n": 10, "top": 9}
    kept = workspace.written(spark.range(3), "y")
    assert kept.count() == 3 and workspace.clear(spark) >= 2
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0] if kept.inputFiles() else "gone").count()


def test_pushed_offsets_give_no_false_rows(spark, folder):
    """An offset alone is no place in every file, and one at which no record begins gives no row and raises nothing."""
    path = str(folder / "in")
    rows = A.read(spark, path, payload="none").select("filename", "offset").collect()
    offset = next(r.offset for r in rows if r.filename == "b.warc" and r.offset)
    want = sorted((r.filename, r.offset) for r in rows if r.offset == offset)
    assert sorted(map(tuple, A.read(spark, path).filter(F.col("offset") == offset).select("filename", "offset").collect())) == want
    for mode in ("permissive", "failfast"):
        for one in ("b.warc", "a.warc.gz"):
            assert A.read(spark, path, mode=mode).filter((F.col("filename") == one) & (F.col("offset") == 10)).count() == 0
        assert A.read(spark, path, mode=mode).filter((F.col("filename") == "b.warc") & (F.col("offset") == 10**9)).count() == 0


def test_overwriting_removes_at_commit(spark, tmp_path):
    """A job that fails leaves what was there, and nothing hidden."""
    from pyspark.sql import DataFrame

    out = str(tmp_path / "out")
    good = A.read(spark, str(_one(tmp_path)))
    A.write(good, out)
    before = sorted(os.listdir(out))

    def broken(batches):
        yield from batches
        raise RuntimeError("lost")

    bad: DataFrame = good.mapInArrow(broken, good.schema)
    with pytest.raises(Exception, match="lost"):
        A.write(bad, out, mode="overwrite")
    assert sorted(os.listdir(out)) == before
    A.write(good.limit(1), out, mode="overwrite")
    assert A.read(spark, out).count() == 1 and not [f for f in os.listdir(out) if f.startswith("_part")]


def _one(tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc(4))
    return tmp_path / "x.warc.gz"


def test_a_job_run_again_takes_the_place_of_its_files(spark, tmp_path):
    rows = A.read(spark, str(_one(tmp_path)))
    for n in (4, 2):
        A.write(rows.repartition(n), str(tmp_path / "out"), job="batch7")
    A.write(rows, str(tmp_path / "out"), job="batch70")
    assert A.read(spark, str(tmp_path / "out")).count() == 8


def test_stream_of_the_source_knows_files_by_name(spark, tmp_path):
    """A file with an older time is not missed, and one that is removed shifts nothing."""
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()

    def run() -> list[str]:
        from quarry.sources.webarchive import register

        register(spark)
        q = spark.readStream.format("webarchive").option("payload", "none").load(str(folder)).select("filename").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(once=True).start()
        q.awaitTermination()
        return sorted({r.filename for r in spark.read.parquet(out).collect()})

    (folder / "m.warc.gz").write_bytes(warc(2))
    (folder / "n.warc.gz").write_bytes(warc(1))
    assert run() == ["m.warc.gz", "n.warc.gz"]
    (folder / "m.warc.gz").unlink()
    (folder / "a.warc.gz").write_bytes(warc(1))
    os.utime(folder / "a.warc.gz", (1, 1))
    assert run() == ["a.warc.gz", "m.warc.gz", "n.warc.gz"] and spark.read.parquet(out).count() == 4


def test_revisits_with_and_without_digest(spark):
    """Records without a digest stay, ties and repeated rows too, and null ids do no harm."""
    h = lambda kind, digest, id_: [{"name": n, "value": v} for n, v in (("WARC-Type", kind), ("WARC-Payload-Digest", digest), ("WARC-Record-ID", id_)) if v]
    rows = [(k, "response", h("response", d, i), bytearray(b"p")) for k, d, i in ((1, "sha1:A", "a"), (2, "sha1:A", "b"), (2, "sha1:A", "b"), (3, None, "c"), (4, "sha1:B", None), (5, "sha1:B", None))]
    rows += [(6, "request", h("request", None, None), bytearray(b"q"))] * 2 + [(7, None, None, None)]
    frame = spark.createDataFrame(rows, f"offset int, rec_type string, rec_headers {HEADERS}, payload binary")
    got = sorted((r.offset, r.rec_type or "", bytes(r.payload or b"")) for r in A.as_revisits(frame, ["offset"]).collect())
    assert got == [(1, "response", b"p"), (2, "revisit", b""), (2, "revisit", b""), (3, "response", b"p"), (4, "response", b"p"), (5, "revisit", b""), (6, "request", b"q"), (6, "request", b"q"), (7, "", b"")]


def test_late_captures_are_left_out(spark, tmp_path):
    """A row that comes after the watermark has passed its window is not counted."""
    folder, out = tmp_path / "in", []
    schema = f"rec_type string, rec_headers {HEADERS}"

    def put(n: int, *hours: int) -> None:
        rows = [("response", [{"name": "WARC-Date", "value": f"2020-01-01T{k:02d}:30:00Z"}]) for k in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        counted = captures_by_hour(spark.readStream.schema(schema).parquet(str(folder)), late="1 hour")
        q = counted.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend((r.start.hour, r.n) for r in b.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(1, 10, 11, 11)
    assert sorted(out) == [(10, 1), (11, 2)]
    put(2, 15)
    out.clear()
    put(3, 10, 15)
    assert out == [(15, 2)]


def test_intermediate_tables_need_a_shared_folder(monkeypatch):
    """Only on a local master is a local folder taken."""
    from types import SimpleNamespace

    from quarry import workspace

    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://node:7077"))
    with pytest.raises(ValueError, match="share"):
        workspace.shared_folder(spark)
