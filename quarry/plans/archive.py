"""Queries over archives: on the table of archive rows, and on archives written from the test tables.

Each has the same query in SQL for comparison. Archives are written to the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import workspace
from quarry.functions import dates as D
from quarry.functions import headers as H
from quarry.functions import uris as U
from quarry.functions.content import with_content
from quarry.functions.digests import digest_matches, digest_of
from quarry.operators import archive as A
from quarry.schema import HEADERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the same in SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "archive_records")


def _header(name: str, headers: str = "rec_headers") -> str:
    """First value of a header in SQL."""
    return f"list_filter({headers}, lambda h: lower(h.name) = '{name.lower()}')[1].value"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


_written: dict[tuple[str, str, bool], str] = {}


def document_archive(spark: SparkSession, sf_dir: str, gzip: bool, **reading: object) -> DataFrame:
    """The documents as resource records, written as an archive (once in a session) and read again."""
    place = (spark.sparkContext.applicationId, sf_dir, gzip)
    folder = _written.get(place)
    if folder is None or not os.path.isdir(folder):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        key = F.col("doc_id").cast("string")
        built = A.build_records(
            docs, F.concat(F.lit("http://docs.example/"), key), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), key,
            F.lit("text/plain"), version="WARC/1.0", keep=["doc_id"],
        )
        folder = _local(workspace.fresh_path(spark, "archive"))
        A.write(built.drop("doc_id"), folder, gzip)
        _written[place] = folder
    return A.read(spark, folder, **reading)


def response_archive(spark: SparkSession, sf_dir: str, gzip: bool = True, **reading: object) -> DataFrame:
    """The records of the archive table, written as an archive and read again."""
    folder = workspace.fresh_path(spark, "archive")
    workspace.small_batches(spark)
    A.write(records(spark, sf_dir).filter("error IS NULL"), _local(folder), gzip)
    return A.read(spark, _local(folder), **reading)


# -- index, fields -------------------------------------------------------------------------------


@query(f"""SELECT record_seq, CAST("offset" AS VARCHAR) AS "offset", {_header('warc-type')} AS "warc-type", {_header('warc-target-uri')} AS "warc-target-uri"
           FROM archive_records WHERE error IS NULL""")
def index_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.index(records(spark, sf_dir), keep=["record_seq"])


@query(f"""SELECT record_seq, string_split(path, '/')[-1] AS filename, CAST(record_length AS VARCHAR) AS length,
           CASE WHEN rec_type IN ('response', 'revisit') AND http_headers IS NOT NULL AND (coalesce(http_statusline, '') <> '' OR len(http_headers) > 0) THEN split_part(http_statusline, ' ', 1) END AS "http:status",
           {_header('content-type', 'http_headers')} AS "http:content-type", {_header('WARC-Record-ID')} AS "WARC-Record-ID" FROM archive_records WHERE error IS NULL""")
def index_http_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.index(records(spark, sf_dir), "filename,length,http:status,http:content-type,WARC-Record-ID", keep=["record_seq"])


@query(f"""SELECT '{{' || concat_ws(', ', '"offset": "' || "offset" || '"', '"warc-type": "' || {_header('warc-type')} || '"', '"warc-record-id": "' || {_header('warc-record-id')} || '"') || '}}' AS value
           FROM archive_records WHERE error IS NULL""")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.index_lines(A.index(records(spark, sf_dir), "offset,warc-type,warc-record-id"))


@query("SELECT rec_type, count(*) AS n, CAST(sum(len(warnings)) AS BIGINT) AS err_count, count(error) AS n_errors FROM archive_records GROUP BY rec_type")
def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("rec_type").agg(F.count("*").alias("n"), F.sum(F.size("warnings")).cast("bigint").alias("err_count"), F.count("error").alias("n_errors"))


# -- scan and write ------------------------------------------------------------------------------

_DOC_SQL = "SELECT 'http://docs.example/' || doc_id AS uri, strlen(coalesce(text, '')) AS length, md5(coalesce(text, '')) AS md5 FROM documents"


def _doc_rows(rows: DataFrame) -> DataFrame:
    return rows.select(H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), "length", F.md5("payload").alias("md5"))


@query(_DOC_SQL)
def scan_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_rows(document_archive(spark, sf_dir, False))


@query(_DOC_SQL)
def scan_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_rows(document_archive(spark, sf_dir, True))


@query("SELECT 'resource' AS rec_type, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS length, CAST(0 AS BIGINT) AS n_payloads FROM documents")
def scan_without_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_archive(spark, sf_dir, True, payload="none", parse_http=False)
    return rows.groupBy("rec_type").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.count("payload").alias("n_payloads"))


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents")
def offsets_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a plain file a record begins where the one before ends, but for its four bytes of line ends."""
    rows = document_archive(spark, sf_dir, False)
    sized = A.with_offsets(rows.withColumn("size", F.col("record_length") + 4), "path", ["record_id_seq"], "size", "expected")
    right = sized.filter(F.col("expected") == F.col("offset"))
    return right.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(f"""SELECT {_header('warc-record-id')} AS id, rec_type, md5(CASE WHEN rec_type = 'revisit' THEN CAST('' AS BLOB) ELSE payload END) AS md5, http_statusline,
           {_header('content-type', 'http_headers')} AS ctype FROM archive_records WHERE error IS NULL""")
def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = response_archive(spark, sf_dir)
    return rows.select(H.get_header("rec_headers", "WARC-Record-ID").alias("id"), "rec_type", F.md5("payload").alias("md5"), F.col("http_statusline"), H.get_header("http_headers", "content-type").alias("ctype"))


@query("SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS n_pass FROM documents")
def check_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything this engine writes has digests that hold."""
    rows = A.check(document_archive(spark, sf_dir, True, check_digests=True, payload="none"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("n_pass"))


@query("SELECT 'http://docs.example/' || doc_id AS uri, md5(coalesce(text, '')) AS md5 FROM documents")
def extract_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record read on its own at the offset of an index."""
    places = document_archive(spark, sf_dir, True, payload="none").select("path", "offset")
    return A.extract_all(places).select(H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), F.md5("payload").alias("md5"))


@query("SELECT 'http://docs.example/' || doc_id AS uri, md5(coalesce(text, '')) AS md5 FROM documents")
def gzip_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes from offset on, as many as the record's length, are a gzip member with the whole record."""
    from quarry.plans.encode import member_payloads

    places = document_archive(spark, sf_dir, True, payload="none").select(H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), "path", "offset", "record_length")
    return member_payloads(places).select("uri", F.md5("payload").alias("md5"))


@query("""SELECT CAST(floor(doc_id / 2) AS BIGINT) AS file, least(count(*), 1) AS n_read, greatest(least(count(*) - 1, 1), 0) AS n_errors, count(*) AS n_joined FROM documents GROUP BY ALL""")
def gzip_members_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records in one gzip member: the second is an error, unless members are read as one stretch."""
    from quarry.plans.encode import joined_members
    from quarry.streaming.archives import parsed_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), F.lit("text/plain"), keep=["doc_id"])
    files = joined_members(A.serialized_records(built, keep=["doc_id"]).select(F.floor(F.col("doc_id") / 2).alias("file"), "data"))
    file = F.col("path").cast("bigint").alias("file")
    plain = parsed_files(files, payload="none").groupBy(file).agg(F.count_if(F.col("error").isNull()).alias("n_read"), F.count("error").alias("n_errors"))
    joined = parsed_files(files, payload="none", gzip_mode="all_members").filter("error IS NULL").groupBy(file).agg(F.count("*").alias("n_joined"))
    return plain.join(joined, "file")


@query("SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents")
def recompress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain archive recompressed into one file with a gzip member for each record, and read again."""
    plain = document_archive(spark, sf_dir, False)
    folder = _local(workspace.fresh_path(spark, "archive"))
    os.makedirs(folder)
    n, repaired = A.recompress(spark, os.path.dirname(plain.select("path").first().path), f"{folder}/all.warc.gz")
    rows = A.read(spark, folder).agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("bytes"))
    return rows.filter((F.col("n") == n) & F.lit(not repaired))


@query("SELECT 'http://docs.example/' || doc_id AS uri, strlen(coalesce(text, '')) AS length FROM documents")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive read as a stream of files until there are no more."""
    from quarry.streaming.archives import read_stream

    docs = document_archive(spark, sf_dir, True)
    folder = docs.select("path").first().path.rpartition("/")[0]
    out, at = workspace.fresh_path(spark, "stream"), workspace.fresh_path(spark, "progress")
    rows = read_stream(spark, "file://" + folder, payload="none")
    indexed = rows.select(H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), "length")
    q = indexed.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("uri string, length bigint").parquet(out)


# -- digests -------------------------------------------------------------------------------------

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _b32(data: str) -> str:
    """Base 32 of the SHA-1 of a blob in SQL: 40 hexadecimal digits by ten."""
    group = f"array_to_string(list_transform(range(0, 4), lambda k: array_to_string(list_transform(range(0, 8), lambda i: substr('{_ALPHABET}', 1 + ((CAST('0x' || substr(sha1({data}), 1 + 10 * k, 10) AS BIGINT) >> (35 - 5 * i)) & 31), 1)), '')), '')"
    return group


def _b32_of_256(data: str) -> str:
    """Base 32 of the SHA-256 of a blob in SQL: six times ten hexadecimal digits, four digits, padding."""
    h = f"sha256({data})"
    char = f"substr('{_ALPHABET}', 1 + (({{n}} >> {{by}}) & 31), 1)"
    ten = char.format(n=f"CAST('0x' || substr({h}, 1 + 10 * k, 10) AS BIGINT)", by="(35 - 5 * i)")
    four = char.format(n=f"(CAST('0x' || substr({h}, 61, 4) AS BIGINT) << 4)", by="(15 - 5 * i)")
    whole = f"array_to_string(list_transform(range(0, 6), lambda k: array_to_string(list_transform(range(0, 8), lambda i: {ten}), '')), '')"
    return f"({whole} || array_to_string(list_transform(range(0, 4), lambda i: {four}), '') || '====')"


@query(f"SELECT record_seq, 'sha1:' || {_b32('payload')} AS digest, 'md5:' || md5(payload) AS md5 FROM archive_records WHERE payload IS NOT NULL")
def digest_b32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("payload IS NOT NULL").select("record_seq", digest_of("payload").alias("digest"), F.concat(F.lit("md5:"), F.md5("payload")).alias("md5"))


_DECLARED = _header("WARC-Payload-Digest")
_VALUE = "substr(declared, instr(declared, ':') + 1)"
_HASH = "CASE WHEN lower(split_part(declared, ':', 1)) = 'sha1' THEN sha1(payload) WHEN lower(split_part(declared, ':', 1)) = 'sha256' THEN sha256(payload) WHEN lower(split_part(declared, ':', 1)) = 'md5' THEN md5(payload) END"
_AS_HEX = f"""CASE WHEN length(v) = 2 * size THEN lower(v) WHEN length(v) < ceil(size / 5.0) * 8 THEN lower(hex(from_base64(replace(replace(v, '-', '+'), '_', '/')))) END"""


@query(f"""WITH d AS (SELECT record_seq, payload, {_DECLARED} AS declared FROM archive_records WHERE rec_type = 'response' AND payload IS NOT NULL),
           e AS (SELECT *, {_VALUE} AS v, CASE WHEN lower(split_part(declared, ':', 1)) = 'sha256' THEN 32 WHEN lower(split_part(declared, ':', 1)) = 'md5' THEN 16 ELSE 20 END AS size, {_HASH} AS h FROM d)
           SELECT record_seq, CASE WHEN h IS NULL THEN NULL WHEN length(v) = 32 AND size = 20 THEN v = {_b32('payload')} WHEN length(v) = 56 AND size = 32 THEN v = {_b32_of_256('payload')}
           WHEN length(v) = 2 * size OR length(v) < ceil(size / 5.0) * 8 THEN coalesce({_AS_HEX} = h, false) END AS ok FROM e""")
def digest_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests declared in base 32, base 64, its URL form and hexadecimal against the payload."""
    declared = H.get_header("rec_headers", "WARC-Payload-Digest")
    rows = records(spark, sf_dir).filter("rec_type = 'response' AND payload IS NOT NULL")
    return rows.select("record_seq", digest_matches(declared, "payload").alias("ok"))


@query("SELECT 'http://docs.example/' || doc_id AS uri, CASE WHEN doc_id % 7 = 0 THEN 'fail' WHEN doc_id % 7 = 1 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN doc_id % 7 IN (0, 1) THEN 1 ELSE 0 END AS n_problems FROM documents")
def check_pass_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written with a wrong payload digest (id 0 modulo 7), one of an unknown algorithm (1), or as a segment, of which only the block is judged (2)."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    given = F.when((k % 7).isin(0, 2), digest_of(F.encode(F.concat(text, F.lit("x")), "UTF-8"))).when(k % 7 == 1, F.lit("whirl:ABC")).otherwise(digest_of(F.encode(text, "UTF-8")))
    wanted = F.array(H.header("WARC-Payload-Digest", given))
    wanted = F.when(k % 7 == 2, F.concat(wanted, F.array(H.header("WARC-Segment-Number", F.lit("2"))))).otherwise(wanted)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://docs.example/"), k), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), k, F.lit("text/plain"), warc_headers=wanted)
    folder = _local(workspace.fresh_path(spark, "archive"))
    A.write(built, folder)
    rows = A.read(spark, folder, check_digests=True)
    verdicts = A.check(rows).select("path", "offset", "verdict", F.size("problems").alias("n_problems"))
    uris = rows.select("path", "offset", H.get_header("rec_headers", "WARC-Target-URI").alias("uri"))
    return uris.join(verdicts, ["path", "offset"]).select("uri", "verdict", "n_problems")


@query(f"""WITH d AS (SELECT rec_type, error, digest.passed AS passed, {_DECLARED} AS declared, coalesce({_header('WARC-Block-Digest')}, '') <> '' OR coalesce({_DECLARED}, '') <> '' AS present FROM archive_records)
           SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN passed IS NOT NULL THEN 'judged' WHEN rec_type = 'revisit' AND present THEN 'revisit' WHEN NOT coalesce(present, false) THEN 'none' ELSE 'judged' END AS kind, count(*) AS n FROM d GROUP BY ALL""")
def check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("verdict").isin("pass", "fail", "unchecked"), "judged").otherwise(F.col("verdict"))
    return A.check(records(spark, sf_dir)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# -- content -------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def content_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts chunked, compressed or both, and decoded again."""
    from quarry.plans.encode import encoded

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_content(encoded(docs)).select("doc_id", F.md5("content").alias("md5"))


@query(f"""SELECT record_seq, octet_length(payload) AS n FROM archive_records WHERE rec_type = 'response'
           AND coalesce({_header('transfer-encoding', 'http_headers')}, '') <> 'chunked' AND coalesce(lower({_header('content-encoding', 'http_headers')}), '') NOT IN ('gzip', 'deflate', 'deflate_alt', 'br')""")
def content_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without a coding are their own content."""
    rows = with_content(records(spark, sf_dir).filter("rec_type = 'response'"))
    te, ce = H.get_header("http_headers", "transfer-encoding", ""), F.lower(H.get_header("http_headers", "content-encoding", ""))
    return rows.filter((te != "chunked") & ~ce.isin("gzip", "deflate", "deflate_alt", "br")).select("record_seq", F.length("content").cast("bigint").alias("n"))


# -- headers -------------------------------------------------------------------------------------


@query(f"""SELECT record_seq, {_header('set-cookie', 'http_headers')} AS first_cookie,
           list_filter(http_headers, lambda h: lower(h.name) = 'set-cookie')[-1].value AS last_cookie,
           len(http_headers) - CASE WHEN len(list_filter(http_headers, lambda h: lower(h.name) = 'set-cookie')) > 0 THEN 1 ELSE 0 END AS n_after,
           coalesce({_header('location', 'http_headers')}, '') <> '' AS has_location FROM archive_records WHERE http_headers IS NOT NULL""")
def header_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading takes the first header of a name, replacing and removing the last."""
    rows = records(spark, sf_dir).filter("http_headers IS NOT NULL")
    last = F.element_at(F.filter("http_headers", lambda h: F.lower(h["name"]) == "set-cookie"), -1)["value"]
    replaced = H.replace_header("http_headers", "SET-COOKIE", "gone")
    was = F.when(F.exists(replaced, lambda h: h["value"] == "gone") & H.has_header("http_headers", "set-cookie"), last)
    removed = H.remove_header("http_headers", "set-cookie")
    return rows.select("record_seq", H.get_header("http_headers", "SET-COOKIE").alias("first_cookie"), was.alias("last_cookie"), F.size(removed).cast("bigint").alias("n_after"), H.has_header("http_headers", "Location").alias("has_location"))


@query("""SELECT record_seq, http_protocol || ' ' || http_statusline || chr(13) || chr(10) ||
          array_to_string(list_transform(http_headers, lambda h: h.name || ': ' || h.value || chr(13) || chr(10)), '') AS block FROM archive_records WHERE http_statusline IS NOT NULL AND http_statusline <> ''""")
def header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("http_statusline <> ''").select("record_seq", H.block_text("http_protocol", "http_statusline", "http_headers").alias("block"))


@query("SELECT record_seq, true AS same FROM archive_records WHERE http_statusline IS NOT NULL AND http_statusline <> ''")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as text and parsed again."""
    rows = records(spark, sf_dir).filter("http_statusline <> ''")
    block = H.parse_block(H.block_text("http_protocol", "http_statusline", "http_headers"))
    staged = rows.withColumn("b", block)
    same = (F.col("b.protocol") == F.col("http_protocol")) & (F.col("b.statusline") == F.col("http_statusline")) & (F.col("b.headers") == F.col("http_headers"))
    return staged.select("record_seq", same.alias("same"))


@query("""SELECT record_seq, split_part(http_statusline, ' ', 1) AS code, CASE WHEN TRY_CAST(split_part(http_statusline, ' ', 1) AS INT) > 0 THEN http_statusline ELSE '204 No Content' END AS valid
          FROM archive_records WHERE http_statusline IS NOT NULL""")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("http_statusline IS NOT NULL")
    return rows.select("record_seq", H.status_code("http_statusline").alias("code"), H.valid_statusline("http_statusline", "204 No Content").alias("valid"))


@query("""SELECT record_seq, '206 Partial Content' AS statusline, 'bytes 10-' || (9 + payload_length) || '/' || (payload_length + 10) AS content_range, CAST(payload_length AS VARCHAR) AS content_length
          FROM archive_records WHERE rec_type = 'response' AND payload_length > 0""")
def header_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("rec_type = 'response' AND payload_length > 0")
    part = rows.withColumn("r", H.add_range("http_headers", F.lit(10), F.col("payload_length"), F.col("payload_length") + 10))
    return part.select("record_seq", "r.statusline", H.get_header("r.headers", "Content-Range").alias("content_range"), H.get_header("r.headers", "Content-Length").alias("content_length"))


# -- URIs ----------------------------------------------------------------------------------------


@query("""SELECT record_seq, replace(CASE WHEN starts_with(u, '<') AND ends_with(u, '>') THEN u[2:-2] ELSE u END, ' ', '%20') AS uri
          FROM (SELECT record_seq, list_filter(rec_headers, lambda h: lower(h.name) = 'warc-target-uri')[1].value AS u FROM archive_records)""")
def uri_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("record_seq", U.repaired_uri(H.get_header("rec_headers", "WARC-Target-URI")).alias("uri"))


@query("SELECT doc_id, replace(url_encode(coalesce(title, '')), '%2F', '/') AS quoted FROM documents")
def percent_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", U.percent_quoted(F.coalesce("title", F.lit(""))).alias("quoted"))


@query("SELECT DISTINCT path, string_split(path, '/')[-1] AS name FROM archive_records WHERE path IS NOT NULL")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("path IS NOT NULL").select("path", U.base_name("path").alias("name")).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'http://other.example/a' ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 'https' ELSE 'http' END) || '://h.example' ||
          CASE WHEN o_orderkey % 5 = 0 THEN ':8080' ELSE '' END || '/p/' || o_custkey END AS url,
          CASE WHEN o_orderkey % 3 = 2 THEN 'http://h.example:' || CASE WHEN o_orderkey % 5 = 0 THEN '8080' WHEN o_orderkey % 2 = 0 THEN '443' ELSE '80' END END AS proxy_host FROM orders""")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    default = F.when(k % 2 == 0, 443).otherwise(80)
    port = F.when(k % 5 == 0, 8080).otherwise(default)
    target = F.when(k % 3 == 2, "http://other.example/a").otherwise(F.concat(F.lit("/p/"), F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.request_url(target, F.lit("h.example"), port, default).alias("r")).select("o_orderkey", "r.url", "r.proxy_host")


# -- dates ---------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
          CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso_micros,
          strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def ts_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", D.time_to_timestamp(t).alias("stamp"), D.time_to_iso(t).alias("iso"), D.time_to_iso(t, True).alias("iso_micros"), D.time_to_http(t).alias("http"), D.timestamp_to_seconds(D.time_to_timestamp(t)).alias("seconds"))


@query("SELECT event_id, ts AS of_iso, date_trunc('second', ts) AS of_http, date_trunc('second', ts) AS of_stamp FROM events")
def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", D.iso_to_time(D.time_to_iso(t, True)).alias("of_iso"), D.http_to_time(D.time_to_http(t)).alias("of_http"), D.timestamp_to_time(D.time_to_timestamp(t)).alias("of_stamp"))


_S = "s || substr('299912', length(s) + 1, greatest(6 - length(s), 0))"
_PART = "CASE WHEN length(t) >= {e} THEN coalesce(greatest({lo}, least(TRY_CAST(substr(t, {a}, {n}) AS INT), {hi})), {hi}) ELSE {hi} END"


@query(f"""WITH a AS (SELECT event_id, {_S} AS t FROM (SELECT event_id, substr(strftime(ts, '%Y%m%d%H%M%S'), 1, CAST(event_id % 15 AS INT)) AS s FROM events)),
           b AS (SELECT event_id, t, {_PART.format(e=4, lo=1900, a=1, n=4, hi=2999)} AS y, {_PART.format(e=6, lo=1, a=5, n=2, hi=12)} AS m FROM a),
           c AS (SELECT *, day(last_day(make_date(y, m, 1))) AS top FROM b)
           SELECT event_id, printf('%04d-%02d-%02dT%02d:%02d:%02dZ', y, m, {_PART.format(e=8, lo=1, a=7, n=2, hi='top')}, {_PART.format(e=10, lo=0, a=9, n=2, hi=23)}, {_PART.format(e=12, lo=0, a=11, n=2, hi=59)}, {_PART.format(e=14, lo=0, a=13, n=2, hi=59)}) AS iso FROM c""")
def ts_pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.substring(D.time_to_timestamp(F.col("ts").cast("timestamp_ntz")), F.lit(1), (F.col("event_id") % 15).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", D.timestamp_to_iso(cut).alias("iso"))


@query(f"""SELECT record_seq, strftime(TRY_CAST(replace({_header('WARC-Date')}, 'Z', '') AS TIMESTAMP), '%Y%m%d%H%M%S') AS stamp FROM archive_records WHERE rec_type = 'response'""")
def record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("rec_type = 'response'").select("record_seq", D.iso_to_timestamp(H.get_header("rec_headers", "WARC-Date")).alias("stamp"))


@query("SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def ts_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = D.time_to_timestamp(F.col("o_orderdate").cast("timestamp_ntz"))
    seconds = D.timestamp_to_seconds(stamp)
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), D.seconds_to_timestamp(seconds).alias("stamp"))


# -- records -------------------------------------------------------------------------------------


def _arc_line() -> Column:
    stamp = D.time_to_timestamp(F.col("ts").cast("timestamp_ntz"))
    k = F.col("event_id")
    uri = F.when(k % 10 == 0, F.concat(F.lit("filedesc://file "), k, F.lit(".arc"))).otherwise(F.concat(F.lit("http://a.example/x y/"), k))
    return F.concat_ws(" ", uri, F.lit("192.0.2.1"), stamp, F.lit("text/html"), F.col("user_id").cast("string"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'warcinfo' ELSE 'response' END AS type, CASE WHEN event_id % 10 = 0 THEN 'file ' || event_id || '.arc' END AS filename,
          CASE WHEN event_id % 10 <> 0 THEN 'http://a.example/x y/' || event_id END AS uri, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date,
          CASE WHEN event_id % 10 = 0 THEN 'text/html' ELSE 'application/http;msgtype=response' END AS ctype, CAST(user_id AS VARCHAR) AS length FROM events""")
def arc2warc_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("h", A.arc_as_warc(A.arc_headers(_arc_line()), F.col("event_id")))
    got = {"type": "WARC-Type", "filename": "WARC-Filename", "uri": "WARC-Target-URI", "date": "WARC-Date", "ctype": "Content-Type", "length": "Content-Length"}
    return rows.select("event_id", *(H.get_header("h", n).alias(a) for a, n in got.items()))


@query(f"""SELECT doc_id, 'WARC/1.0' AS protocol, 'resource' AS type, 'http://d.example/' || doc_id AS uri, '2020-01-01T00:00:00Z' AS date, 'sha1:' || {_b32("encode(coalesce(text, ''))")} AS digest,
           CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents""")
def build_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), F.lit("text/plain"), keep=["doc_id"])
    got = {"type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest"}
    return built.select("doc_id", F.col("rec_protocol").alias("protocol"), *(H.get_header("rec_headers", n).alias(a) for a, n in got.items()), "length")


@query("""SELECT batch_no, 'software: quarry' || chr(13) || chr(10) || CASE WHEN coalesce(operator, '') <> '' THEN 'operator: ' || operator || chr(13) || chr(10) ELSE '' END ||
          'isPartOf: ' || crawl_kind || chr(13) || chr(10) AS body FROM batches""")
def warcinfo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = A.warcinfo_body([("software", F.lit("quarry")), ("operator", F.col("operator")), ("isPartOf", F.col("crawl_kind"))])
    return table(spark, sf_dir, "batches").select("batch_no", body.alias("body"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha1(coalesce(text, '')) ORDER BY doc_id) > 1 THEN 'revisit' ELSE 'response' END AS rec_type,
          CASE WHEN row_number() OVER (PARTITION BY sha1(coalesce(text, '')) ORDER BY doc_id) > 1 THEN 'http://d.example/' || first_value(doc_id) OVER (PARTITION BY sha1(coalesce(text, '')) ORDER BY doc_id) END AS refers_to FROM documents""")
def revisit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "response", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), keep=["doc_id"])
    return A.as_revisits(built, ["doc_id"]).select("doc_id", "rec_type", H.get_header("rec_headers", "WARC-Refers-To-Target-URI").alias("refers_to"))


@query(f"""WITH q AS (SELECT {_header('warc-record-id')} AS request_id, {_header('warc-concurrent-to')} AS other FROM archive_records WHERE rec_type = 'request'),
           r AS (SELECT {_header('warc-record-id')} AS response_id, {_header('warc-target-uri')} AS uri FROM archive_records WHERE rec_type = 'response')
           SELECT request_id, response_id, uri FROM q LEFT JOIN r ON other = response_id""")
def pair_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired(records(spark, sf_dir))


@query(f"""WITH o AS (SELECT {_header('warc-record-id')} AS id, {_header('warc-target-uri')} AS uri, {_header('warc-date')} AS date, {_DECLARED} AS digest FROM archive_records WHERE rec_type = 'response'),
           v AS (SELECT {_header('warc-record-id')} AS revisit_id, {_header('warc-refers-to-target-uri')} AS uri, {_header('warc-refers-to-date')} AS date, {_DECLARED} AS digest FROM archive_records WHERE rec_type = 'revisit')
           SELECT revisit_id, coalesce(p.id, d.id) AS original_id FROM v LEFT JOIN (SELECT uri, date, min(id) AS id FROM o GROUP BY ALL) p ON v.uri = p.uri AND v.date = p.date
           LEFT JOIN (SELECT digest, min(id) AS id FROM o WHERE digest IS NOT NULL GROUP BY ALL) d ON v.digest = d.digest""")
def revisit_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.resolved_revisits(records(spark, sf_dir))


@query(f"""SELECT {_header('warc-record-id')} AS id, http_statusline FROM archive_records WHERE rec_type = 'response' AND TRY_CAST(split_part(http_statusline, ' ', 1) AS INT) BETWEEN 200 AND 299""")
def capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("rec_type = 'response'")
    kept = A.filtered_pairs(rows, H.status_code("http_statusline").try_cast("int").between(200, 299))
    return kept.select(H.get_header("rec_headers", "WARC-Record-ID").alias("id"), "http_statusline")


@query("""SELECT o_orderkey AS exchange_id, 0 AS place, 'response' AS rec_type, 'http://h.example/o/' || o_orderkey AS uri, '200 OK' AS statusline, CAST(length(o_orderpriority) AS BIGINT) AS length FROM orders
          UNION ALL SELECT o_orderkey, 1, 'request', 'http://h.example/o/' || o_orderkey, '/o/' || o_orderkey || ' HTTP/1.1', CAST(0 AS BIGINT) FROM orders""")
def capture_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    request = F.concat(F.lit("GET /o/"), k, F.lit(" HTTP/1.1\r\nHost: h.example\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n"), F.col("o_orderpriority"))
    exchanges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("exchange_id"), request.cast("binary").alias("request"), response.cast("binary").alias("response"), F.lit("h.example").alias("host"),
        F.lit(80).alias("port"), F.lit(80).alias("default_port"), F.lit("192.0.2.9").alias("ip"), F.col("o_orderdate").alias("time"),
    )
    rows = A.exchange_records(exchanges)
    return rows.select("exchange_id", "place", "rec_type", H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), F.col("http_statusline").alias("statusline"), "length")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 0 WHEN s_suppkey % 4 = 2 THEN s_suppkey END AS length FROM supplier")
def bad_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths that are negative or no numbers are 0, a missing one is unknown."""
    from quarry.plans.encode import framed_length

    k = F.col("s_suppkey")
    declared = F.when(k % 4 == 0, F.concat(F.lit("-"), k)).when(k % 4 == 1, F.concat(k, F.lit("x"))).when(k % 4 == 2, k.cast("string"))
    return framed_length(table(spark, sf_dir, "supplier").select("s_suppkey", declared.alias("declared")), "s_suppkey", "declared")


@query("""SELECT event_id, 'response' AS type, 'http://a.example/x y/' || event_id AS uri, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, CAST(strlen(event_type) AS BIGINT) AS payload_length, event_type AS payload FROM events""")
def scan_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARC files of a hundred records each, read as WARC records."""
    from quarry.streaming.archives import parsed_files

    k = F.col("event_id")
    body = F.concat(F.lit("HTTP/1.0 200 OK\nContent-Type: text/plain\n\n"), F.col("event_type"))
    line = F.concat_ws(" ", F.concat(F.lit("http://a.example/x y/"), k), F.lit("192.0.2.1"), D.time_to_timestamp(F.col("ts").cast("timestamp_ntz")), F.lit("text/plain"), F.octet_length(body).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.floor(k / 100).alias("file"), k.alias("k"), F.concat(line, F.lit("\n"), body, F.lit("\n")).alias("record"))
    top = F.lit("filedesc://x.arc 192.0.2.1 20200101000000 text/plain 23\n1 0 Example\nURL Length\n\n")
    files = rows.groupBy("file").agg(F.concat(top, F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "record"))), lambda r: r["record"]), "")).cast("binary").alias("content"))  # a hundred records a file
    got = parsed_files(files.select(F.concat(F.col("file").cast("string"), F.lit(".arc")).alias("path"), "content"), arc2warc=True).filter("rec_type = 'response'")
    uri = H.get_header("rec_headers", "WARC-Target-URI")
    return got.select(F.substring_index(uri, "/", -1).cast("bigint").alias("event_id"), F.col("rec_type").alias("type"), with_blanks(uri).alias("uri"), H.get_header("rec_headers", "WARC-Date").alias("date"), "payload_length", F.col("payload").cast("string").alias("payload"))


def with_blanks(uri: Column) -> Column:
    """Blanks of a repaired URI again."""
    return F.replace(uri, F.lit("%20"), F.lit(" "))


@query(f"""SELECT date_trunc('hour', TRY_CAST(replace({_header('WARC-Date')}, 'Z', '') AS TIMESTAMP)) AS start, rec_type, count(*) AS n FROM archive_records
           WHERE TRY_CAST(replace({_header('WARC-Date')}, 'Z', '') AS TIMESTAMP) IS NOT NULL GROUP BY ALL""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by the hour of their date, counted over a stream of the record table."""
    from quarry.streaming.archives import captures_by_hour

    rows = records(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/archive_records.parque[t]")
    out, at = workspace.fresh_path(spark, "hours"), workspace.fresh_path(spark, "progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = captures_by_hour(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    counts = spark.read.schema("start timestamp, rec_type string, n bigint, batch int").parquet(out)
    return counts.groupBy("start", "rec_type").agg(F.max_by("n", "batch").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT doc_id, 'revisit' AS type, 'http://d.example/' || doc_id AS uri, 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' AS profile, 'http://d.example/0' AS refers_to,
          '2019-01-01T00:00:00Z' AS refers_date, 'sha1:X' AS digest, 'application/http; msgtype=response' AS content_type, CAST(0 AS BIGINT) AS length FROM documents""")
def build_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    given = F.array(*A.revisit_headers(F.lit("sha1:X"), F.lit("http://d.example/0"), F.lit("2019-01-01T00:00:00Z"), "WARC/1.1"))
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "revisit", date=F.lit("2020-01-01T00:00:00Z"), identity=F.col("doc_id"), warc_headers=given, version="WARC/1.1", keep=["doc_id"])
    got = {"type": "WARC-Type", "uri": "WARC-Target-URI", "profile": "WARC-Profile", "refers_to": "WARC-Refers-To-Target-URI", "refers_date": "WARC-Refers-To-Date", "digest": "WARC-Payload-Digest"}
    return built.select("doc_id", *(H.get_header("rec_headers", n).alias(a) for a, n in got.items()), "content_type", "length")


_CRLF = "chr(13) || chr(10)"
_TEXT = "coalesce(text, '')"


@query(f"""SELECT doc_id, md5(array_to_string(['WARC/1.0', 'WARC-Type: resource',
           'WARC-Record-ID: <urn:uuid:' || regexp_replace(md5(CAST(doc_id AS VARCHAR)), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>',
           'WARC-Target-URI: http://d.example/' || doc_id, 'WARC-Date: 2020-01-01T00:00:00Z', 'WARC-Payload-Digest: sha1:' || {_b32(f'encode({_TEXT})')}, 'WARC-Block-Digest: sha1:' || {_b32(f'encode({_TEXT})')},
           'Content-Type: text/plain', 'Content-Length: ' || strlen({_TEXT}), '', {_TEXT}, '', ''], {_CRLF})) AS md5 FROM documents""")
def serialize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of records as they are written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), F.lit("text/plain"), keep=["doc_id"])
    return A.serialized_records(built, keep=["doc_id"]).select("doc_id", F.md5("data").alias("md5"))


@query("""SELECT s_suppkey, 0 AS step, CAST(NULL AS VARCHAR) AS url FROM supplier WHERE FALSE
          UNION ALL SELECT s_suppkey, 1, 'https://shop' || s_nationkey || '.example' || CASE WHEN s_suppkey % 2 = 0 THEN ':8443' ELSE '' END || '/s/' || s_suppkey FROM supplier
          UNION ALL SELECT s_suppkey, 2, 'https://shop' || s_nationkey || '.example' || CASE WHEN s_suppkey % 2 = 0 THEN ':8443' ELSE '' END || '/again' FROM supplier""")
def connect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that follow CONNECT on their connection go to the tunnel's host; CONNECT itself has no record."""
    k = F.col("s_suppkey")
    place = F.concat(F.lit("shop"), F.col("s_nationkey"), F.lit(".example:"), F.when(k % 2 == 0, "8443").otherwise("443"))
    first = F.array(F.concat(F.lit("CONNECT "), place), F.concat(F.lit("GET /s/"), k), F.lit("GET /again"))
    steps = table(spark, sf_dir, "supplier").select(k, F.posexplode(first).alias("step", "line"))
    exchanges = steps.select(
        (k * 3 + F.col("step")).alias("exchange_id"), k.alias("connection"), F.concat("line", F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n")).cast("binary").alias("request"), F.lit("HTTP/1.1 200 OK\r\n\r\n").cast("binary").alias("response"),
        F.lit("proxy.example").alias("host"), F.lit(3128).alias("port"), F.lit(443).alias("default_port"), F.lit(None).cast("string").alias("ip"), F.timestamp_seconds(F.col("step")).cast("timestamp_ntz").alias("time"),
    )
    rows = A.exchange_records(exchanges).filter("rec_type = 'request'")
    return rows.select(F.floor(F.col("exchange_id") / 3).cast("bigint").alias("s_suppkey"), (F.col("exchange_id") % 3).cast("int").alias("step"), H.get_header("rec_headers", "WARC-Target-URI").alias("url"))


@query("SELECT doc_id, md5('Text: ' || coalesce(text, '')) AS md5 FROM documents")
def content_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are not what their headers say pass as they are; a chunked body may end early or lack its last chunk."""
    from quarry.functions.content import with_content

    k, text = F.col("doc_id") % 4, F.encode(F.concat(F.lit("Text: "), F.coalesce("text", F.lit(""))), "UTF-8")
    size = F.hex(F.length(text) + F.when(k == 2, 5).otherwise(0))
    body = F.when(k == 0, text).when(k == 1, text).when(k == 2, F.concat(F.encode(F.concat(size, F.lit("\r\n")), "UTF-8"), text)).otherwise(F.concat(F.encode(F.concat(size, F.lit(";x=y\r\n")), "UTF-8"), text, F.encode(F.lit("\r\n"), "UTF-8")))
    te = F.array(H.header("Transfer-Encoding", F.lit("chunked")))
    ce = F.array(H.header("Content-Encoding", F.lit("GZip")))
    headers = F.when(k == 0, F.concat(te, ce)).when(k == 1, ce).otherwise(te)
    rows = table(spark, sf_dir, "documents").select("doc_id", headers.alias("http_headers"), body.alias("payload"))
    return with_content(rows).select("doc_id", F.md5("content").alias("md5"))


@query("SELECT 'http://docs.example/' || doc_id AS uri, 'WARC/1.1' AS version FROM documents")
def written_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as another version, and the same job run twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://docs.example/"), "doc_id"), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), F.lit("text/plain"))
    folder = _local(workspace.fresh_path(spark, "archive"))
    for _ in range(2):
        A.write(built, folder, job="load1", warc_version="WARC/1.1")
    return A.read(spark, folder, payload="none").select(H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), F.col("rec_protocol").alias("version"))


@query("SELECT doc_id, 'http://d.example/' || doc_id AS uri, strlen(coalesce(text, '')) AS length, md5(coalesce(text, '')) AS md5 FROM documents")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records held as bytes in a column, plain and compressed by turns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    built = A.build_records(docs, F.concat(F.lit("http://d.example/"), "doc_id"), "resource", F.col("text"), F.lit("2020-01-01T00:00:00Z"), F.col("doc_id"), F.lit("text/plain"), keep=["doc_id"])
    odd = F.col("doc_id") % 2 == 1
    data = A.serialized_records(built.filter(odd), keep=["doc_id"]).unionByName(A.serialized_records(built.filter(~odd), True, keep=["doc_id"]))
    return A.parsed_records(data, keep=["doc_id"]).select("doc_id", H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), "length", F.md5("payload").alias("md5"))


@query("""SELECT o_orderkey, 'HTTP/1.1' AS protocol, '200 OK' AS statusline, 'text/x; v=' || o_custkey AS type, CAST(2 AS INT) AS n_headers, CAST(length(o_orderpriority) AS BIGINT) AS length, md5(o_orderpriority) AS md5 FROM orders""")
def build_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response records whose HTTP headers are parsed out of the payload."""
    raw = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/x; v="), F.col("o_custkey"), F.lit("\r\nX-Empty:\r\n\r\n"), F.col("o_orderpriority")).cast("binary")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("message"))
    built = A.build_http_records(rows, F.concat(F.lit("http://o.example/"), "o_orderkey"), "response", "message", date=F.lit("2020-01-01T00:00:00Z"), identity=F.col("o_orderkey"), keep=["o_orderkey"])
    return built.select("o_orderkey", F.col("http_protocol").alias("protocol"), F.col("http_statusline").alias("statusline"), H.get_header("http_headers", "content-type").alias("type"), F.size("http_headers").alias("n_headers"), "length", F.md5("payload").alias("md5"))


@query("""SELECT batch_no, 'warcinfo' AS type, 'batch-' || batch_no || '.warc.gz' AS filename, CAST(NULL AS VARCHAR) AS uri, 'application/warc-fields' AS content_type,
          concat('crawl: ', crawl_kind, chr(13), chr(10), CASE WHEN coalesce(operator, '') <> '' THEN 'operator: ' || operator || chr(13) || chr(10) ELSE '' END) AS body FROM batches""")
def build_warcinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warcinfo record for each batch."""
    rows = table(spark, sf_dir, "batches")
    filename = F.concat(F.lit("batch-"), "batch_no", F.lit(".warc.gz"))
    built = A.build_warcinfo(rows, filename, [("crawl", F.col("crawl_kind")), ("operator", F.col("operator"))], date=F.lit("2020-01-01T00:00:00Z"), identity=F.col("batch_no"), keep=["batch_no"])
    return built.select("batch_no", F.col("rec_type").alias("type"), H.get_header("rec_headers", "WARC-Filename").alias("filename"), H.get_header("rec_headers", "WARC-Target-URI").alias("uri"), "content_type", F.col("payload").cast("string").alias("body"))


@query("""SELECT o_orderkey, 1 AS n_headers, CAST(length('HTTP/1.1 200 OK' || 'X-Kept: ' || o_custkey) + 6 + length(o_orderpriority) AS BIGINT) AS length FROM orders""")
def write_without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses written without some of their HTTP headers."""
    raw = F.concat(F.lit("HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nX-Kept: "), F.col("o_custkey"), F.lit("\r\nset-cookie: b\r\n\r\n"), F.col("o_orderpriority")).cast("binary")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("message"))
    built = A.build_http_records(rows, F.concat(F.lit("http://o.example/"), "o_orderkey"), "response", "message", date=F.lit("2020-01-01T00:00:00Z"), identity=F.col("o_orderkey"))
    folder = _local(workspace.fresh_path(spark, "archive"))
    A.write(built, folder, drop_http_headers="Set-Cookie")
    got = A.read(spark, folder)
    key = F.substring_index(H.get_header("rec_headers", "WARC-Target-URI"), "/", -1).cast("bigint").alias("o_orderkey")
    return got.select(key, F.size("http_headers").alias("n_headers"), "length")
