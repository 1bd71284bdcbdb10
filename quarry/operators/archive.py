"""The verbs over archives: index, check, extract, recompress, build, pair, deduplicate to revisits."""

from __future__ import annotations

import io
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import workspace
from quarry.codec.container import ArchiveError, Options, read_records
from quarry.codec.serialize import gzip_member, serialized
from quarry.functions.dates import time_to_iso, timestamp_to_iso
from quarry.functions.digests import SIZES, digest_matches, digest_of
from quarry.functions.headers import add_header, get_header, has_header, header, remove_header, replace_header, status_code
from quarry.functions.uris import base_name
from quarry.schema import HEADERS
from quarry.sources.webarchive import arrow_batches, local_path, plain_row, register, rows_of_file, to_arrow

#: Content types of records by type, and of any other; fixed values.
CONTENT_TYPES = {
    "warcinfo": "application/warc-fields",
    "response": "application/http; msgtype=response",
    "revisit": "application/http; msgtype=response",
    "request": "application/http; msgtype=request",
    "metadata": "application/warc-fields",
}
OTHER_TYPE = "application/warc-record"
REVISIT_PROFILES = {
    "WARC/1.0": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
    "WARC/1.1": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
}


def read(spark: SparkSession, path: str | Sequence[str], **options: object) -> DataFrame:
    """Records of archive files; see quarry.sources.webarchive for the options.

    Files that the workers can open (local or mounted ones) are read in a stream. Those of other file
    systems that Hadoop knows come through the binaryFile source, so each must be below 2 GB.
    """
    first = path if isinstance(path, str) else path[0]
    if "://" in first and not first.startswith("file:"):
        from quarry.streaming.archives import parsed_files

        files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
        return parsed_files(files, **options)
    register(spark)
    paths = path if isinstance(path, str) else ",".join(path)
    return spark.read.format("webarchive").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(paths)


def write(records: DataFrame, path: str, gzip: bool = True, mode: str = "append", one_file: bool = False, order: Sequence[str] = ("path", "record_id_seq"), **options: str) -> None:
    """Write records as archive files below a folder; one_file keeps all of them in order in one task.

    Options: ``job`` (a name, so that the same job run again takes the place of its files),
    ``warc_version``, ``drop_http_headers`` (names of HTTP headers that are not written).
    """
    register(records.sparkSession)
    rows = records
    if one_file:
        rows = records.coalesce(1).sortWithinPartitions(*(c for c in order if c in records.columns))
    rows.write.format("webarchive").option("gzip", str(gzip).lower()).options(**options).mode(mode).save(path)


# -- index ---------------------------------------------------------------------------------------


def field_expr(name: str) -> Column:
    """A field of the index: offset, length, filename, http:status, http:<header> or a record header; text or null."""
    if name == "offset":
        return F.col("offset").cast("string")
    if name == "length":
        return F.col("record_length").cast("string")
    if name == "filename":
        return base_name("path")
    if name == "http:status":
        block = F.col("http_headers").isNotNull() & ((F.coalesce("http_statusline", F.lit("")) != "") | (F.size("http_headers") > 0))
        return F.when(F.col("rec_type").isin("response", "revisit") & block, status_code("http_statusline"))
    if name.startswith("http:"):
        return get_header("http_headers", name[5:])
    return get_header("rec_headers", name)


def index(records: DataFrame, fields: str | Sequence[str] = "offset,warc-type,warc-target-uri", names: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One text column for each field, renamed by names; columns in keep go along. Rows of errors are left out."""
    wanted = fields.split(",") if isinstance(fields, str) else list(fields)
    rows = records.filter("error IS NULL") if "error" in records.columns else records
    return rows.select(*keep, *(field_expr(f).alias((names or {}).get(f, f)) for f in wanted))


def index_lines(indexed: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """``value``: a JSON object a row, fields in order, nulls left out, with blanks after : and , and only ASCII."""
    wanted = list(fields or indexed.columns)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [json.dumps({k: r[k] for k in wanted if r[k] is not None}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return indexed.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(part, "value string")


def needs_http(fields: str | Sequence[str]) -> bool:
    """Whether a field makes it necessary to parse HTTP headers."""
    return any(f.startswith("http:") for f in (fields.split(",") if isinstance(fields, str) else fields))


# -- check ---------------------------------------------------------------------------------------


def check(records: DataFrame) -> DataFrame:
    """Verdict on the digests of records, from the worker's ``digest`` where there is one, else computed here from the payload.

    verdict: pass, fail, revisit (there, not judged), unchecked, none; error rows are ``error``.
    """
    revisit = F.coalesce(F.col("rec_type") == "revisit", F.lit(False))
    segment = get_header("rec_headers", "WARC-Segment-Number").isNotNull()
    staged = records.withColumn("_declared", F.when(~revisit & ~segment, get_header("rec_headers", "WARC-Payload-Digest")))
    staged = staged.withColumn("_ok", F.when(F.col("digest").isNull() & (F.coalesce("length", F.lit(-1)) >= 0), digest_matches("_declared", "payload")))
    known = F.lower(F.substring_index("_declared", ":", 1)).isin(*SIZES) & F.contains(F.col("_declared"), F.lit(":"))
    problems = F.when(F.col("_declared").isNotNull() & ~known, F.array(F.lit("unknown hash algorithm name in payload digest"))).when(
        F.col("_ok") == F.lit(False), F.array(F.concat(F.lit("payload digest failed"), F.when(F.length("payload") == 0, ":").otherwise(""), F.lit(" "), F.col("_declared")))
    )
    own = F.struct(F.when(F.size(problems) > 0, F.lit(False)).when(F.col("_ok"), F.lit(True)).alias("passed"), F.coalesce(problems, F.array().cast("array<string>")).alias("problems"))
    digest = F.coalesce("digest", own)
    present = has_header("rec_headers", "WARC-Payload-Digest") | has_header("rec_headers", "WARC-Block-Digest")
    verdict = (
        F.when(F.col("error").isNotNull(), "error")
        .when(digest["passed"] == F.lit(False), "fail")
        .when(digest["passed"], "pass")
        .when(present & revisit, "revisit")
        .when(present, "unchecked")
        .otherwise("none")
    )
    return staged.select("path", "offset", get_header("rec_headers", "WARC-Record-ID").alias("record_id"), "rec_type", verdict.alias("verdict"), digest["problems"].alias("problems"), "error")


def exit_code(checked: DataFrame) -> int:
    """1 if some record failed or some file could not be read, else 0."""
    return int(checked.filter("verdict IN ('fail', 'error')").limit(1).count() > 0)


#: What is said of a record in the verbose report; fixed values.
MESSAGES = {"pass": "digest pass", "revisit": "digest present but not checked (revisit)", "unchecked": "digest present but not checked", "none": "no digest to check"}


# -- extract -------------------------------------------------------------------------------------


def extract(path: str, offset: int, part: str = "record") -> bytes:
    """Bytes of the record at an offset: record, payload (content codings undone) or headers."""
    from quarry.codec.headers import Block, ascii_bytes, text_of
    from quarry.codec.http import decode_content
    from quarry.codec.headers import get

    row = next(rows_of_file(local_path(path), Options(), True, start=offset, limit=1))
    if part == "payload":
        return decode_content(row["payload"], get(row["http_headers"], "transfer-encoding"), get(row["http_headers"], "content-encoding"))[0] or b""
    top = text_of(Block(row["rec_protocol"] or "", "", row["rec_headers"])).encode() + b"\r\n"
    http = ascii_bytes(Block(row["http_protocol"] or "", row["http_statusline"] or "", row["http_headers"])) if row["http_headers"] is not None else b""
    return top + http + (b"" if part == "headers" else row["payload"] or b"")


def extract_all(places: DataFrame, **options: object) -> DataFrame:
    """Records at (path, offset) of a table, each read on its own: parallel inside files too."""
    chosen = Options(**options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, file = None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != name:
                        if file is not None:
                            file.close()
                        name, file = r["path"], open(local_path(r["path"]), "rb")
                    file.seek(r["offset"])
                    for x in read_records(file, chosen, r["offset"], 1):
                        yield x | {"path": r["path"], "filename": os.path.basename(r["path"])}
        finally:
            if file is not None:
                file.close()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches(rows(batches))

    from quarry.schema import RECORDS

    return places.select("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(part, RECORDS)


def parsed_records(rows: DataFrame, data: str = "data", keep: Sequence[str] = (), **options: object) -> DataFrame:
    """The columns in keep and the first record of the bytes (plain or a gzip member) in a column; null or empty bytes give no row."""
    from quarry.schema import RECORDS

    workspace.small_batches(rows.sparkSession)
    chosen = Options(**options)
    schema = rows.select(*keep).schema.simpleString()[7:-1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for row in read_records(io.BytesIO(value or b""), chosen, limit=1):
                    at.append(k)
                    found.append(row)
            if found:
                kept, made = batch.select(list(keep)).take(pa.array(at, pa.int64())), to_arrow(found)
                yield pa.RecordBatch.from_arrays([*kept.columns, *made.columns], [*keep, *made.schema.names])

    return rows.select(*keep, data).mapInArrow(part, (schema + "," if schema else "") + RECORDS)


# -- records -------------------------------------------------------------------------------------


def record_id(seed: Column) -> Column:
    """A record id; the same for the same seed."""
    h = F.md5(seed.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if k else ()) + (F.substring(h, a, n),)), F.lit(">"))


def warc_date(time: Column, version: str = "WARC/1.0") -> Column:
    """Date of a record; with micros from version 1.1 on."""
    return time_to_iso(time, micros=version >= "WARC/1.1")


def version_name(version: str | float | None) -> str:
    """WARC/1.0 for nothing; 1.1 is WARC/1.1."""
    text = str(version or "WARC/1.0")
    return text if text.startswith("WARC/") else "WARC/" + text


def split_http(message: Column | str) -> tuple[Column, Column]:
    """(struct of protocol, statusline and headers, body) of the bytes of an HTTP message; all of it is head without an empty line."""
    from quarry.functions.headers import parse_block

    raw = F.col(message) if isinstance(message, str) else message
    text = F.decode(raw, "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    return parse_block(F.when(at > 0, F.substring(text, F.lit(1), at + 1)).otherwise(text)), F.when(at > 0, F.substring(raw, at + 4, F.length(raw))).otherwise(F.lit(b""))


def build_http_records(rows: DataFrame, uri: Column, rec_type: str, message: str, **given: object) -> DataFrame:
    """build_records() of response or request records whose HTTP headers stand at the start of the bytes in a column."""
    block, body = split_http(message)
    staged = rows.withColumn("_message", F.explode(F.array(block)))  # parsed once
    parts = {f"http_{n}": F.col(f"_message.{n}") for n in ("protocol", "statusline", "headers")}
    return build_records(staged, uri, rec_type, body, **parts, **given)


def build_warcinfo(rows: DataFrame, filename: Column, fields: Sequence[tuple[str, Column]], **given: object) -> DataFrame:
    """warcinfo records that name the file they open, with ``name: value`` lines as their body."""
    return build_records(rows, F.lit(None).cast("string"), "warcinfo", warcinfo_body(fields), warc_headers=F.array(header("WARC-Filename", filename)), **given)


def build_records(
    rows: DataFrame,
    uri: Column,
    rec_type: Column | str,
    payload: Column | None = None,
    date: Column | None = None,
    identity: Column | None = None,
    content_type: Column | None = None,
    warc_headers: Column | None = None,
    http_protocol: Column | None = None,
    http_statusline: Column | None = None,
    http_headers: Column | None = None,
    version: str = "WARC/1.0",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Records of the archive row schema from columns.

    Headers given come first; WARC-Type, Record-ID, Target-URI and Date follow if missing. The payload
    digest is added unless the type has none. Without payload the record is empty.
    """
    kind = F.lit(rec_type) if isinstance(rec_type, str) else rec_type
    body = F.coalesce(payload.cast("binary") if payload is not None else F.lit(None).cast("binary"), F.lit(b""))
    h = F.coalesce(warc_headers, F.array().cast(HEADERS)) if warc_headers is not None else F.array().cast(HEADERS)
    h = replace_header(h, "WARC-Type", kind)
    new_id = record_id(identity) if identity is not None else F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    when = date if date is not None else warc_date(F.current_timestamp(), version)
    staged = rows.withColumn("_type", kind).withColumn("_body", body).withColumn("_uri", uri).withColumn("_h", h)
    staged = staged.withColumn("_h", F.when(has_header("_h", "WARC-Record-ID"), F.col("_h")).otherwise(add_header("_h", "WARC-Record-ID", new_id)))
    staged = staged.withColumn("_h", F.when(F.coalesce("_uri", F.lit("")) != "", replace_header("_h", "WARC-Target-URI", F.col("_uri"))).otherwise(F.col("_h")))
    staged = staged.withColumn("_h", F.when(has_header("_h", "WARC-Date"), F.col("_h")).otherwise(add_header("_h", "WARC-Date", when)))
    digest = F.col("_type").isin("warcinfo", "revisit") | has_header("_h", "WARC-Payload-Digest")
    staged = staged.withColumn("_h", F.when(digest, F.col("_h")).otherwise(add_header("_h", "WARC-Payload-Digest", digest_of("_body"))))
    default = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv)), F.col("_type")), F.lit(OTHER_TYPE))
    ctype = F.coalesce(*([content_type] if content_type is not None else []), get_header("_h", "Content-Type"), default)
    length = F.length("_body").cast("bigint")
    return staged.select(
        *keep,
        F.lit("warc").alias("format"),
        F.col("_type").alias("rec_type"),
        F.lit(version).alias("rec_protocol"),
        F.col("_h").alias("rec_headers"),
        (http_protocol if http_protocol is not None else F.lit(None).cast("string")).alias("http_protocol"),
        (http_statusline if http_statusline is not None else F.lit(None).cast("string")).alias("http_statusline"),
        (http_headers if http_headers is not None else F.lit(None).cast(HEADERS)).alias("http_headers"),
        ctype.alias("content_type"),
        length.alias("length"),
        length.alias("payload_length"),
        F.col("_body").alias("payload"),
    )


def warcinfo_body(fields: Sequence[tuple[str, Column]]) -> Column:
    """``name: value`` lines of a warcinfo record; null and empty values are left out."""
    return F.concat(*(F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(n + ": "), v.cast("string"), F.lit("\r\n"))).otherwise("") for n, v in fields))


def revisit_headers(digest: Column, refers_to_uri: Column, refers_to_date: Column, version: str = "WARC/1.0") -> list[Column]:
    """The headers that make a record a revisit."""
    return [
        header("WARC-Profile", REVISIT_PROFILES.get(version, REVISIT_PROFILES["WARC/1.0"])),
        header("WARC-Refers-To-Target-URI", refers_to_uri),
        header("WARC-Refers-To-Date", refers_to_date),
        header("WARC-Payload-Digest", digest),
    ]


def as_revisits(records: DataFrame, order: Sequence[Column | str], version: str = "WARC/1.0") -> DataFrame:
    """Responses whose payload digest came before become revisits of the first one; other records stay as they are.

    The first of a digest is found by an aggregate over the few columns it needs, not by a window, so
    that a digest of a third of all rows is no task of its own. The digests that come again are written
    first, so that their size is known: if it is small, no payload is shuffled. Else records without a
    digest are spread by their places instead of sharing a key. Ties go by the record id.
    """
    digest = get_header("rec_headers", "WARC-Payload-Digest")
    place = F.struct(*order, get_header("rec_headers", "WARC-Record-ID").alias("_id"))
    marked = records.withColumn("_digest", F.when(F.col("rec_type") == "response", digest)).withColumn("_place", place)
    own = F.struct(get_header("rec_headers", "WARC-Target-URI").alias("uri"), get_header("rec_headers", "WARC-Date").alias("date"))
    firsts = marked.filter("_digest IS NOT NULL").select("_digest", "_place", own.alias("_own")).groupBy("_digest").agg(F.min("_place").alias("_first"), F.min_by("_own", "_place").alias("_of"), F.count("*").alias("_n"))
    again = workspace.written(firsts.filter("_n > 1").select(F.col("_digest").alias("_key"), "_first", "_of"), "firsts")
    key = F.coalesce("_digest", F.concat(F.lit("\0"), F.xxhash64("_place").cast("string")))
    is_later = F.coalesce(F.col("_place") > F.col("_first"), F.lit(False))
    kept = replace_header(remove_header(remove_header("rec_headers", "WARC-Payload-Digest"), "WARC-Block-Digest"), "WARC-Type", "revisit")
    more = F.array(*revisit_headers(F.col("_digest"), F.col("_of.uri"), F.col("_of.date"), version))
    return (
        marked.withColumn("_key", key)
        .join(again, "_key", "left")
        .withColumn("rec_headers", F.when(is_later, F.concat(kept, more)).otherwise(F.col("rec_headers")))
        .withColumn("rec_type", F.when(is_later, "revisit").otherwise(F.col("rec_type")))
        .withColumn("payload", F.when(is_later, F.lit(b"")).otherwise(F.col("payload")))
        .drop("_key", "_digest", "_place", "_first", "_of")
    )


def resolved_revisits(records: DataFrame) -> DataFrame:
    """revisit_id, original_id (null if not there) of every revisit: by URI and date it refers to, else by digest."""
    uri, date, digest = (get_header("rec_headers", n) for n in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"))
    own = get_header("rec_headers", "WARC-Record-ID")
    originals = records.filter("rec_type = 'response'")
    by_place = originals.groupBy(uri.alias("o_uri"), date.alias("o_date")).agg(F.min(own).alias("by_place"))
    by_digest = originals.filter(digest.isNotNull()).groupBy(digest.alias("o_digest")).agg(F.min(own).alias("by_digest"))
    revisits = records.filter("rec_type = 'revisit'").select(own.alias("revisit_id"), get_header("rec_headers", "WARC-Refers-To-Target-URI").alias("r_uri"), get_header("rec_headers", "WARC-Refers-To-Date").alias("r_date"), digest.alias("r_digest"))
    found = revisits.join(by_place, (F.col("r_uri") == F.col("o_uri")) & (F.col("r_date") == F.col("o_date")), "left").join(by_digest, F.col("r_digest") == F.col("o_digest"), "left")
    return found.select("revisit_id", F.coalesce("by_place", "by_digest").alias("original_id"))


def paired(records: DataFrame) -> DataFrame:
    """request_id, response_id, uri of requests and the responses they are concurrent to; unpaired requests have a null response."""
    own = get_header("rec_headers", "WARC-Record-ID")
    requests = records.filter("rec_type = 'request'").select(own.alias("request_id"), get_header("rec_headers", "WARC-Concurrent-To").alias("other"))
    responses = records.filter("rec_type = 'response'").select(own.alias("response_id"), get_header("rec_headers", "WARC-Target-URI").alias("uri"))
    return requests.join(responses, F.col("other") == F.col("response_id"), "left").select("request_id", "response_id", "uri")


def pair_rows(pairs: DataFrame, request: str = "request", response: str = "response", key: str = "pair") -> DataFrame:
    """Records of pairs of record structs, the response first; the request takes its URI and date and names its id."""
    r, q = F.col(f"{response}.rec_headers"), F.col(f"{request}.rec_headers")
    new = replace_header(replace_header(q, "WARC-Target-URI", get_header(r, "WARC-Target-URI")), "WARC-Date", get_header(r, "WARC-Date"))
    other = get_header(r, "WARC-Record-ID")
    new = F.when(F.coalesce(other, F.lit("")) != "", add_header(new, "WARC-Concurrent-To", other)).otherwise(new)
    both = F.array(F.col(response), F.col(request).withField("rec_headers", new))
    return pairs.select(key, F.posexplode(both).alias("place", "record")).select(key, "place", "record.*")


def arc_headers(line: Column) -> Column:
    """The five fields of an ARC record line, cut from the right: an URI may hold blanks."""
    pattern = r"^(.*) (\S*) (\S*) (\S*) (\S*)$"
    return F.struct(*(F.regexp_extract(F.rtrim(line), pattern, k + 1).alias(n) for k, n in enumerate(("uri", "ip_address", "archive_date", "content_type", "length"))))


def arc_as_warc(fields: Column, identity: Column) -> Column:
    """Record headers for the fields of an ARC record."""
    info = F.startswith(fields["uri"], F.lit("filedesc://"))
    place = F.when(info, header("WARC-Filename", F.substring(fields["uri"], F.lit(12), F.length(fields["uri"])))).otherwise(header("WARC-Target-URI", fields["uri"]))
    return F.array(
        header("WARC-Type", F.when(info, "warcinfo").otherwise("response")),
        header("WARC-Record-ID", record_id(identity)),
        place,
        header("WARC-IP-Address", fields["ip_address"]),
        header("WARC-Date", timestamp_to_iso(fields["archive_date"])),
        header("Content-Type", F.when(info, fields["content_type"]).otherwise("application/http;msgtype=response")),
        header("Content-Length", fields["length"]),
    )


def with_offsets(sized: DataFrame, file: str, order: Sequence[str], size: str, start: str = "offset") -> DataFrame:
    """Offset of each record in its file: the sum of the sizes before it. A file's records are one task, as in the file itself."""
    before = W.partitionBy(file).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0)))


def serialized_records(records: DataFrame, gzip: bool = False, header_filter: Callable | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The columns in keep and ``data``: each record as it would be written."""
    workspace.small_batches(records.sparkSession)
    needed = ["rec_type", "rec_protocol", "rec_headers", "http_protocol", "http_statusline", "http_headers", "content_type", "length", "payload_length", "payload"]
    chosen = records.select(*keep, *(n for n in needed if n not in keep))
    schema = chosen.select(*keep).schema.simpleString()[7:-1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [serialized(plain_row(r), header_filter) for r in batch.to_pylist()]
            if gzip:
                data = [gzip_member(d) for d in data]
            yield pa.RecordBatch.from_arrays([*batch.select(list(keep)).columns, pa.array(data, pa.binary())], [*keep, "data"])

    return chosen.mapInArrow(part, (schema + "," if schema else "") + "data:binary")


# -- recompress ----------------------------------------------------------------------------------


def recompress(spark: SparkSession, path: str, output: str) -> tuple[int, bool]:
    """Write an archive anew, a gzip member for each record, ARC as WARC; (records, whether it had to be repaired).

    If it can't be read record by record, it is read as one stretch of decompressed bytes. What can't
    be read then either raises ArchiveError.
    """
    for joined in (False, True):
        options = {"arc2warc": True, "mode": "failfast"} | ({"gzip_mode": "all_members"} if joined else {})
        folder = tempfile.mkdtemp(prefix="recompress-", dir=os.path.dirname(os.path.abspath(output)))
        try:
            write(read(spark, path, **options), folder, one_file=True)
            n = 0
            with open(output, "wb") as out:
                for name in sorted(f for f in os.listdir(folder) if f.startswith("part-")):
                    with open(os.path.join(folder, name), "rb") as f:
                        shutil.copyfileobj(f, out)
                    n += sum(1 for _ in rows_of_file(os.path.join(folder, name), Options(payload=False)))
            return n, joined
        except Exception as e:  # Spark wraps what its workers raise
            if not isinstance(e, ArchiveError) and "ArchiveError" not in str(e):
                raise
            if joined:
                raise ArchiveError(str(e)) from e
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    raise AssertionError


# -- capture -------------------------------------------------------------------------------------


def exchange_records(exchanges: DataFrame, key: str = "exchange_id", version: str = "WARC/1.0") -> DataFrame:
    """Records of recorded HTTP exchanges, the response of each first.

    Columns: key, request and response bytes, host, port, default_port, ip (null if not known), time,
    and optionally connection: exchanges that follow a CONNECT on the same connection go to its host.
    CONNECT itself has no URL and gives no records.
    """
    from quarry.functions.uris import request_url

    q, q_body = split_http("request")
    r, r_body = split_http("response")
    staged = exchanges.select("*", F.explode(F.array(q)).alias("_q")).select("*", F.explode(F.array(r)).alias("_r"))  # parsed once
    target, opens = F.substring_index(F.col("_q.statusline"), " ", 1), F.upper("_q.protocol") == "CONNECT"
    tunnel = F.lit(None).cast("string")
    if "connection" in exchanges.columns:  # the exchanges of one connection are few
        before = W.partitionBy("connection").orderBy("time", key).rowsBetween(W.unboundedPreceding, -1)
        tunnel = F.when(F.col("connection").isNotNull(), F.last(F.when(opens, target), True).over(before))
    staged = staged.withColumn("_to", request_url(target, F.col("host"), F.col("port"), F.col("default_port"), F.col("_q.protocol"), tunnel)).filter("_to.url IS NOT NULL")
    extra = F.concat(
        F.when(F.col("ip").isNotNull(), F.array(header("WARC-IP-Address", F.col("ip")))).otherwise(F.array().cast(HEADERS)),
        F.when(F.col("_to.proxy_host").isNotNull(), F.array(header("WARC-Proxy-Host", F.col("_to.proxy_host")))).otherwise(F.array().cast(HEADERS)),
    )
    out = []
    for kind, block, body in (("response", "_r", r_body), ("request", "_q", q_body)):
        built = build_records(
            staged, F.col("_to.url"), kind, body, warc_date(F.col("time"), version), F.concat_ws("-", F.col(key).cast("string"), F.lit(kind)), warc_headers=extra,
            http_protocol=F.col(f"{block}.protocol"), http_statusline=F.col(f"{block}.statusline"), http_headers=F.col(f"{block}.headers"), version=version, keep=[key],
        )
        out.append(built.select(key, F.struct(*(c for c in built.columns if c != key)).alias(kind)))
    pairs = out[0].join(out[1], key)
    return pair_rows(pairs, key=key)


def filtered_pairs(pairs: DataFrame, keep: Column) -> DataFrame:
    """Pairs for which a condition over request and response holds."""
    return pairs.filter(keep)


def requests_as_revisits(pairs: DataFrame, seen: DataFrame, digest: Column) -> DataFrame:
    """pairs with ``is_revisit``: whether the digest of the response is in seen.digest."""
    known = seen.select(F.col("digest").alias("_seen")).distinct()
    return pairs.withColumn("_digest", digest).join(known, F.col("_digest") == F.col("_seen"), "left").withColumn("is_revisit", F.col("_seen").isNotNull()).drop("_digest", "_seen")
