"""The data source ``webarchive``: archive files as rows, in batch and streams, and rows as archive files.

Catalyst does not prune the columns of Python data sources, so what is not wanted is named by
options: ``payload`` (raw, none), ``parse_http``, ``check_digests``. Filters on ``path``,
``filename`` and, with one of these, ``offset`` reach the reader where the session allows pushdown for
Python sources (spark.sql.python.filterPushdown.enabled); Spark applies them again, so this is only a
saving. An offset at which no record begins gives no row.

A file is one task, since records can't be found from the middle of it. A plain table of (path,
offset) makes extraction parallel inside a file: see quarry.operators.archive.extract_all.
"""

from __future__ import annotations

import fnmatch
import logging
import os
import uuid
from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from quarry.codec.container import ArchiveError, Options, read_records
from quarry.codec.serialize import gzip_member, serialized
from quarry.schema import COLUMNS, RECORDS

_log = logging.getLogger("quarry")
#: Rows and payload bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
ARROW = pa.schema(
    [
        ("record_id_seq", pa.int64()),
        *((n, pa.string()) for n in ("path", "filename", "format", "rec_type", "rec_protocol")),
        ("rec_headers", _HEADERS),
        ("http_protocol", pa.string()),
        ("http_statusline", pa.string()),
        ("http_headers", _HEADERS),
        ("content_type", pa.string()),
        ("length", pa.int64()),
        ("payload_length", pa.int64()),
        ("payload", pa.binary()),
        ("offset", pa.int64()),
        ("record_length", pa.int64()),
        ("digest", pa.struct([("passed", pa.bool_()), ("problems", pa.list_(pa.string()))])),
        ("warnings", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)


def local_path(path: str) -> str:
    """A path that open() takes."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def files_below(path: str) -> list[str]:
    """Files of a path, a folder (without hidden ones) or a pattern, in order; several are separated by commas."""
    out: list[str] = []
    for one in path.split(","):
        p = local_path(one.strip())
        if os.path.isdir(p):
            for at, folders, names in os.walk(p):
                folders[:] = sorted(f for f in folders if not f.startswith((".", "_")))
                out += sorted(os.path.join(at, n) for n in names if not n.startswith((".", "_")))
        elif any(c in p for c in "*?["):
            at = os.path.dirname(p) or "."
            out += sorted(os.path.join(at, n) for n in os.listdir(at) if fnmatch.fnmatch(n, os.path.basename(p)))
        else:
            out.append(p)
    return out


def _flag(options: CaseInsensitiveDict | dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).strip().lower() in ("true", "1", "yes", "log", "raise")


def reading(options: CaseInsensitiveDict | dict) -> Options:
    """Reader options by the names of the data source's options."""
    return Options(
        format=(options.get("format_only") or options.get("archiveFormat") or None),
        parse_http=_flag(options, "parse_http", True),
        verify_http=_flag(options, "verify_http", False),
        arc2warc=_flag(options, "arc2warc", False),
        ensure_http_headers=_flag(options, "ensure_http_headers", False),
        check_digests=_flag(options, "check_digests", False),
        payload=str(options.get("payload", "raw")).lower() != "none",
        all_members=str(options.get("gzip_mode", "")).lower() == "all_members",
        max_payload=int(options.get("max_payload_bytes", 1 << 30)),
    )


def rows_of_file(path: str, options: Options, failfast: bool = False, digest_policy: str = "", start: int = 0, limit: int | None = None) -> Iterator[dict[str, Any]]:
    """Rows of one file with path and filename; an error raises if failfast, else it is the last row."""
    name = os.path.basename(path)
    with open(path, "rb") as f:
        f.seek(start)
        for row in read_records(f, options, start, limit):
            if failfast and row.get("error"):
                raise ArchiveError(f"{path}: {row['error']}")
            verdict = row.get("digest")
            if verdict and verdict[1]:
                if digest_policy == "raise":
                    raise ArchiveError(f"{path}: {verdict[1][0]}")
                if digest_policy == "log":
                    _log.warning("%s, offset %s: %s", path, row.get("offset"), "; ".join(verdict[1]))
            yield row | {"path": path, "filename": name}


def arrow_batches(rows: Iterator[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by count and payload bytes."""
    held: list[dict[str, Any]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield to_arrow(held)
            held, size = [], 0
    if held:
        yield to_arrow(held)


def to_arrow(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    def headers(h: Sequence | None) -> list[dict[str, str]] | None:
        return None if h is None else [{"name": n, "value": v} for n, v in h]

    fields = {}
    for name in COLUMNS:
        values = [r.get(name) for r in rows]
        if name in ("rec_headers", "http_headers"):
            values = [headers(v) for v in values]
        elif name == "digest":
            values = [None if v is None else {"passed": v[0], "problems": list(v[1])} for v in values]
        elif name == "warnings":
            values = [v or [] for v in values]
        fields[name] = pa.array(values, ARROW.field(name).type)
    return pa.RecordBatch.from_arrays(list(fields.values()), schema=ARROW)


class FilePartition(InputPartition):
    """A file, or what begins at start; ``pushed`` if a filter and not the caller asked for that."""

    def __init__(self, path: str, start: int = 0, limit: int | None = None, pushed: bool = False) -> None:
        self.path, self.start, self.limit, self.pushed = path, start, limit, pushed


class ArchiveReader(DataSourceReader):
    def __init__(self, options: CaseInsensitiveDict) -> None:
        self.options = dict(options)
        self.equal: dict[str, Any] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("path", "filename", "offset"):
                self.equal[f.attribute[0]] = f.value
            yield f  # and again by Spark

    def partitions(self) -> Sequence[InputPartition]:
        pushed = "offset" in self.equal and "offset" not in self.options and ("path" in self.equal or "filename" in self.equal)
        start = int(self.equal["offset"] if pushed else self.options.get("offset", 0))
        limit = int(self.options["limit"]) if "limit" in self.options else 1 if pushed else None
        files = files_below(self.options.get("path") or self.options["paths"])
        if "path" in self.equal:
            files = [f for f in files if f == self.equal["path"]]
        if "filename" in self.equal:
            files = [f for f in files if os.path.basename(f) == self.equal["filename"]]
        return [FilePartition(f, start, limit, pushed) for f in files if not pushed or 0 <= start < os.path.getsize(f)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no partitions
            return iter(())
        failfast = str(self.options.get("mode", "permissive")).lower() == "failfast" and not partition.pushed
        policy = str(self.options.get("check_digests", "")).lower()
        rows = rows_of_file(partition.path, reading(self.options), failfast, policy, partition.start, partition.limit)
        if partition.pushed:  # no record need begin there
            rows = (r for r in rows if not r.get("error"))
        return arrow_batches(rows)


class ArchiveStreamReader(DataSourceStreamReader):
    """New files of a folder, each a task. The offset has the names of the files seen.

    So it is for folders of some thousands of files; quarry.streaming.archives has a stream for any number.
    """

    def __init__(self, options: CaseInsensitiveDict) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": files_below(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        seen = set(start["files"])
        return [FilePartition(f) for f in end["files"] if f not in seen]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        failfast = str(self.options.get("mode", "permissive")).lower() == "failfast"
        policy = str(self.options.get("check_digests", "")).lower()
        return arrow_batches(rows_of_file(partition.path, reading(self.options), failfast, policy))


class Written(WriterCommitMessage):
    def __init__(self, path: str, records: int) -> None:
        self.path, self.records = path, records


class ArchiveWriter(DataSourceArrowWriter):
    """One file for each task, first hidden, shown when the job commits; rows in the order they come.

    Overwriting removes the archives that were there when the job commits, not before. ``job`` names
    the files; a job of the same name takes the place of what it wrote before. ``mode`` ignore and
    errorifexists are Spark's.
    """

    def __init__(self, options: CaseInsensitiveDict, overwrite: bool) -> None:
        self.options = dict(options)
        self.folder = local_path(self.options["path"])
        self.gzip = _flag(self.options, "gzip", True)
        self.overwrite = overwrite
        self.named = bool(self.options.get("job"))
        self.job = self.options.get("job") or uuid.uuid4().hex[:12]
        self.attempt = uuid.uuid4().hex[:8]
        self.version = self.options.get("warc_version")
        self.dropped = {x.strip().lower() for x in self.options.get("drop_http_headers", "").split(",") if x.strip()}
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.warc" + (".gz" if self.gzip else "")
        hidden = os.path.join(self.folder, f"_{name}.{self.attempt}-{context.taskAttemptId()}")
        n = 0
        with open(hidden, "wb") as f:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row.get("error"):
                        continue
                    data = serialized(self._without(plain_row(row)) | ({"rec_protocol": self.version} if self.version else {}))
                    f.write(gzip_member(data) if self.gzip else data)
                    n += 1
        return Written(hidden, n)

    def _without(self, row: dict[str, Any]) -> dict[str, Any]:
        """A row without the HTTP headers that are not written."""
        if self.dropped and row.get("http_headers"):
            row["http_headers"] = [(n, v) for n, v in row["http_headers"] if n.lower() not in self.dropped]
        return row

    def commit(self, messages: list[Written | None]) -> None:
        for name in os.listdir(self.folder):
            if name.startswith("part-") and ".warc" in name and (self.overwrite or self.named and f"-{self.job}.warc" in name):
                os.remove(os.path.join(self.folder, name))
        for m in messages:
            if m is not None:
                name = os.path.basename(m.path)[1:].rpartition(".")[0]
                if m.records:
                    os.replace(m.path, os.path.join(self.folder, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what the job left hidden, failed tasks' files too."""
        for name in os.listdir(self.folder):
            if name.startswith("_part-") and f".{self.attempt}-" in name:
                os.remove(os.path.join(self.folder, name))


def plain_row(row: dict[str, Any]) -> dict[str, Any]:
    """A row from Arrow with headers as pairs."""
    for name in ("rec_headers", "http_headers"):
        if row.get(name) is not None:
            row[name] = [(h["name"], h["value"]) for h in row[name]]
    return row


class WebArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: Any) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return ArchiveStreamReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("webarchive") known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebArchive)

