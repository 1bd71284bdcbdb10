"""Content of payloads: transfer and content codings undone.

Payloads without a coding never leave the JVM: those that have one are decoded by an Arrow function
in batches bounded by rows and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.codec.http import DECOMPRESSORS, decode_content
from quarry.functions.headers import get_header


def with_content(records: DataFrame, all_members: bool = False) -> DataFrame:
    """records with ``content`` and ``content_warning``.

    Chunked is only what Transfer-Encoding calls exactly that; Content-Encoding counts in any case
    if it is a known name. Null payloads have null content.
    """
    workspace.small_batches(records.sparkSession)
    te, ce = get_header("http_headers", "transfer-encoding"), F.lower(get_header("http_headers", "content-encoding"))
    coded = F.coalesce(te == "chunked", F.lit(False)) | F.coalesce(ce.isin(*DECOMPRESSORS), F.lit(False))
    marked = records.withColumn("_te", te).withColumn("_ce", ce).withColumn("_coded", coded & F.col("payload").isNotNull())
    plain = marked.filter("NOT _coded").drop("_te", "_ce", "_coded").withColumn("content", F.col("payload")).withColumn("content_warning", F.lit(None).cast("string"))
    rows = marked.filter("_coded").drop("_coded")
    kept = [c for c in rows.columns if c not in ("_te", "_ce")]
    schema = plain.schema

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode_content(p, t, c, all_members) for p, t, c in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("payload", "_te", "_ce")))]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], [*kept, "content", "content_warning"])

    return plain.unionByName(rows.mapInArrow(part, schema))
