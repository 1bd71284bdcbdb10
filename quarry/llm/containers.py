"""Filling containers of a fixed number of tokens with documents.

Only the histogram of lengths decides, and documents find their place by the rank among those of
their length. Lengths are at most the capacity, so histogram and plan are bounded whatever the number
of documents.

Two plans are offered. ``by_buckets`` is optimal length buckets: dynamic programming over the
histogram chooses the boundaries that minimise padding, and token-budget batches form inside each
bucket, as many items as fit if each is as long as the bucket's bound. It leaves the space below the
bound unused, and the rest of the capacity that no further item of the bucket fits. ``best_fit`` is
best-fit decreasing on counts: from the longest length down, items go where the least sufficient
space is left. It needs no buckets; their boundaries do not change what it does. filled() takes
best_fit, as little unused space is what is asked for; README has the figures of both.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pages import columns
from quarry.llm.tokens import VOCABULARY, parts, ranked, with_tokens

BUCKETS = 16


def bucket_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the buckets that minimise padding (each length filled up to its bound), ascending."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0 and k > 0), np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[int(k)] for k in lengths], float)
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + (count[j] - count[:j]) * lengths[j - 1] - (mass[j] - mass[:j])
            k = int(cost.argmin())
            now[j], cut[j] = cost[k], k
        best = now
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


class Placement(NamedTuple):
    """Items of a length with ranks from first on: each of n containers from start on takes so many of them."""

    length: int
    first: int
    each: int
    start: int
    n: int


def by_buckets(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[list[Placement], int]:
    """Placements of all items up to the capacity in batches of their bucket, and the number of containers.

    A batch holds capacity // bound items of its bucket, in falling length; the last batch of a bucket may hold fewer.
    """
    out: list[Placement] = []
    used = low = 0
    for high in bucket_boundaries({k: n for k, n in histogram.items() if k <= capacity}, buckets):
        most, room = capacity // high, 0
        for length in sorted((k for k, n in histogram.items() if low < k <= high and n), reverse=True):
            left, first = histogram[length], 0
            if room:  # the batch that the length before left open
                n = min(room, left)
                out.append(Placement(length, first, n, used - 1, 1))
                first, left, room = first + n, left - n, room - n
            full, rest = divmod(left, most)
            if full:
                out.append(Placement(length, first, most, used, full))
                first, used = first + most * full, used + full
            if rest:
                out.append(Placement(length, first, rest, used, 1))
                used, room = used + 1, most - rest
        low = high
    return out, used


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements of all items up to the capacity, and the number of containers."""
    open_: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    out: list[Placement] = []
    used = 0

    def keep(room: int, start: int, n: int) -> None:
        if n and room:
            if room not in open_:
                bisect.insort(rooms, room)
            open_[room].append((start, n))

    for length in sorted((k for k, n in histogram.items() if 0 < k <= capacity and n), reverse=True):
        left, first = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, start, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append(Placement(length, first, each, start, full))
                keep(room - each * length, start, full)
                first += each * full
                left -= each * full
            if full < n:
                if left:  # fewer than fill one more
                    out.append(Placement(length, first, left, start + full, 1))
                    keep(room - left * length, start + full, 1)
                    first += left
                    left = 0
                    full += 1
                keep(room, start + full, n - full)
    return out, used


def filled(documents: DataFrame, capacity: int, path: str = VOCABULARY, plan: Callable[[dict[int, int], int], tuple[list[Placement], int]] = best_fit) -> DataFrame:
    """container, doc_id, piece, first_token, n_tokens: the place of every document, by best_fit or by_buckets.

    A document larger than a container is cut into pieces of the capacity and a rest; no other is
    cut. Null and empty texts have no tokens and no place. Repeated documents are placed one by
    one. Ties of length go by doc_id; extra columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = documents.sparkSession
    items = pieces(with_tokens(documents, path=path), capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(documents))).cast("int"))
    histogram = {r.n_tokens: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity rows
    placements, _ = plan(histogram, capacity)
    table = spark.sparkContext.broadcast(_by_length(placements))  # bounded like the histogram

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = table.value
        for batch in batches:
            where = []
            for n, rank in columns(batch, "n_tokens", "rank"):
                starts, rows = firsts[n]
                p = rows[bisect.bisect_right(starts, rank) - 1]
                where.append(p.start + (rank - p.first) // p.each)
            kept = batch.select(["doc_id", "piece", "first_token", "n_tokens"])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *kept.columns], ["container", *kept.schema.names])

    return ranked(items, ["n_tokens"], "doc_id", "piece").mapInArrow(part, "container bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint")


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, first_token, n_tokens of the items of documents with tokens; more than one piece where larger than the capacity."""
    number = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece")
    cut = sized.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("all"), number)
    first = F.col("piece").cast("bigint") * capacity
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.col("all") - first, F.lit(capacity).cast("bigint")).alias("n_tokens"))


def _by_length(placements: list[Placement]) -> dict[int, tuple[list[int], list[Placement]]]:
    out: dict[int, tuple[list[int], list[Placement]]] = {}
    for p in placements:
        starts, rows = out.setdefault(p.length, ([], []))
        starts.append(p.first)
        rows.append(p)
    return out


def oversized(placed: DataFrame) -> DataFrame:
    """doc_id of the documents that had to be cut."""
    return placed.filter("piece = 1").select("doc_id").distinct()
