"""Streams of archive files.

Files that arrive in a folder are read by the built-in binaryFile stream, so Spark keeps track of
them and any Hadoop file system will do; each is parsed by the same code as in batch, in the
workers. A file is one row there: archives of more than 2 GB belong to the batch source.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.codec.container import read_records
from quarry.functions.dates import iso_to_time
from quarry.functions.headers import get_header
from quarry.schema import RECORDS
from quarry.sources.webarchive import arrow_batches, reading

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def parsed_files(files: DataFrame, **options: Any) -> DataFrame:
    """Records of files given as rows of path and content, in batch or a stream."""
    chosen = reading(options)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = read_records(io.BytesIO(content or b""), chosen)
                yield from arrow_batches(r | {"path": path, "filename": os.path.basename(path)} for r in rows)

    return files.select("path", "content").mapInArrow(part, RECORDS)


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8, **options: Any) -> DataFrame:
    """A stream of the records of files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", str(files_per_trigger)).load(folder)
    return parsed_files(files, **options)


def write_stream(records: DataFrame, folder: str, checkpoint: str, gzip: bool = True, **trigger: Any) -> StreamingQuery:
    """Write a stream of records as archive files, a job for each micro-batch; one that is run again takes the place of its first run."""
    from quarry.operators.archive import write

    def each(batch: DataFrame, number: int) -> None:
        write(batch, folder, gzip, job=f"batch{number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def captures_by_hour(records: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """start, rec_type, n of captures by their date, with a watermark for those that come late."""
    timed = records.select("rec_type", iso_to_time(get_header("rec_headers", "WARC-Date")).cast("timestamp").alias("time")).filter("time IS NOT NULL")
    counted = timed.withWatermark("time", late).groupBy(F.window("time", width), "rec_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "rec_type", "n")
