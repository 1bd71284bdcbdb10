"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.pages import columns

#: Vocabulary in the format of tiktoken; a parameter, never copied.
VOCABULARY = os.environ.get("QUARRY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How that vocabulary's texts are cut before merging; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of about this many characters, cut before white space.
PIECE = 200_000


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text; special tokens' names are ordinary text. Long texts are cut where a blank follows a letter, which is a cut of the pattern too."""
    tool = encoding(path)
    if len(text) <= PIECE:
        return len(tool.encode_ordinary(text))
    total = at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and end + 1 < len(text) and text[end + 1].isalnum()) and end < at + 2 * PIECE:
            end += 1
        total += len(tool.encode_ordinary(text[at:end]))
        at = end
    return total


def with_tokens(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns in keep, n_tokens; null texts have 0 tokens. Written to the shared folder."""
    workspace.small_batches(documents.sparkSession)
    columns_ = documents.select("doc_id", *keep, "text")
    schema = columns_.drop("text").schema.simpleString()[7:-1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t, path) if t else 0 for (t,) in columns(batch, "text")]
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64())], [*kept.schema.names, "n_tokens"])

    return workspace.written(columns_.mapInArrow(part, schema + ",n_tokens:bigint"), "tokens")


def ranked(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """rows with rank (from 0) within keys, by a column salt and then order.

    ``rows`` must have an integer column salt that cuts large groups into parts: ranks are taken in
    each part, and the sizes of the parts before it are added, so no task holds a whole group.
    """
    parts = rows.groupBy(*keys, "salt").agg(F.count("*").alias("_size"))
    before = parts.withColumn("_before", F.sum("_size").over(W.partitionBy(*keys).orderBy("salt")) - F.col("_size")).drop("_size")
    within = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "salt").orderBy(*order)) - 1)
    return within.join(before, [*keys, "salt"]).withColumn("rank", F.col("_rank") + F.col("_before")).drop("_rank", "_before", "salt")


def parts(rows: DataFrame) -> int:
    """Into how many parts ranked() should cut a group: as many as there are shuffle partitions."""
    return max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
