"""Encoders that make test inputs for the decoding queries."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.codec.container import Options, read_records
from quarry.schema import HEADERS

#: Coding by doc_id modulo 5: none, chunked, gzip, zlib deflate, chunked raw deflate.
_KINDS = ((None, None), ("chunked", None), (None, "gzip"), (None, "deflate"), ("chunked", "deflate"))


def chunked(data: bytes, size: int = 1000) -> bytes:
    parts = [data[k : k + size] for k in range(0, len(data), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _coded(text: str, kind: int) -> bytes:
    data = text.encode()
    if kind == 2:
        tool = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = tool.compress(data) + tool.flush()
    elif kind == 3:
        data = zlib.compress(data)
    elif kind == 4:
        tool = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = tool.compress(data) + tool.flush()
    return chunked(data) if kind in (1, 4) else data


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, http_headers, payload: the texts in transfer and content codings that change with doc_id."""
    workspace.small_batches(docs.sparkSession)
    headers = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kinds = [i % 5 for i in ids]
            h = [[{"name": n, "value": v} for n, v in zip(("Transfer-Encoding", "Content-Encoding"), _KINDS[k]) if v] for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h, headers), pa.array([_coded(t, k) for t, k in zip(texts, kinds)], pa.binary())], ["doc_id", "http_headers", "payload"])

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id bigint, http_headers {HEADERS}, payload binary")


def framed_length(rows: DataFrame, key: str, declared: str) -> DataFrame:
    """key, length of a record whose Content-Length is declared so (null: without one)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for v in values:
                head = "WARC/1.0\r\nWARC-Type: resource\r\n" + (f"Content-Length: {v}\r\n" if v is not None else "") + "\r\n"
                out.append(next(read_records(io.BytesIO(head.encode()), Options()))["length"])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.int64())], [key, "length"])

    return rows.select(F.col(key).cast("bigint"), declared).mapInArrow(part, f"{key} bigint, length bigint")


def member_payloads(places: DataFrame) -> DataFrame:
    """uri, payload: the bytes of records at (path, offset, record_length), each decompressed as one gzip member."""
    workspace.small_batches(places.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, payloads = [], []
            for r in batch.to_pylist():
                with open(r["path"], "rb") as f:
                    f.seek(r["offset"])
                    data = gzip.decompress(f.read(r["record_length"]))
                uris.append(r["uri"])
                payloads.append(data.partition(b"\r\n\r\n")[2].removesuffix(b"\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(payloads, pa.binary())], ["uri", "payload"])

    return places.select("uri", "path", "offset", "record_length").sortWithinPartitions("path", "offset").mapInArrow(part, "uri string, payload binary")


def joined_members(rows: DataFrame) -> DataFrame:
    """path, content: the data of each file (two records) in one gzip member."""
    workspace.small_batches(rows.sparkSession)
    both = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list("data")), lambda x: F.hex(x)), "").alias("data"))  # two records a file

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [str(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([gzip.compress(bytes.fromhex(x)) for x in batch.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return both.mapInArrow(part, "path string, content binary")
