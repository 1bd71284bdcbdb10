"""Mixing sources to target shares of all tokens.

For each source the budget is its share of the total. Whole rounds over the source come first, as
many as fit and its cap allows. What is left is a subset-sum problem on the counts of documents by
exact length: the same part of every length is taken, rounded down, then one more of those whose part
was cut off most, and a bounded knapsack over the documents left closes the gap, which is kept as long as
the longest document so that it has a choice. Which documents of a length are taken is decided by a seeded hash.

The total is the size of the mix that is asked for, by default that of the corpus. Sources that can't
fill their budget within their cap then stay below their share of it, and the mix is smaller than asked
for. FEASIBLE takes the largest total at which every source that has any text keeps its share.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import VOCABULARY, parts, ranked, with_tokens

SEED = 17
#: As a total: the largest one at which no source with text falls short of its share.
FEASIBLE = "feasible"


class Share(NamedTuple):
    source: str
    rounds: int
    take: dict[int, int]
    tokens: int


def knapsack(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length, at most those given, whose sum is as near to room as can be without passing it.

    Sums are the bits of one integer; each length enters in powers of two of its count.
    """
    bits, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length, n in sorted(counts.items(), reverse=True):
        n, k = min(n, room // length if length else 0), 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, bits))
            bits |= (bits << (length * k)) & limit
            n -= k
            k *= 2
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    out: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def fit(source: str, counts: dict[int, int], budget: int, max_repeats: int) -> Share:
    """How often and how many documents of each length of a source are used to meet its budget."""
    counts = {k: n for k, n in counts.items() if k > 0 and n > 0}
    whole = sum(k * n for k, n in counts.items())
    if not whole or budget <= 0 or max_repeats <= 0:
        return Share(source, 0, {}, 0)
    rounds = min(budget // whole, max_repeats)
    left = budget - rounds * whole
    take: dict[int, int] = {}
    if rounds < max_repeats:
        for k, n in counts.items():
            take[k] = n * left // whole
        room = left - sum(k * n for k, n in take.items())
        longest = max(counts)
        for k in sorted(counts, key=lambda k: (-(counts[k] * left % whole), -k)):
            if room >= k + longest and take[k] < counts[k]:
                take[k] += 1
                room -= k
        for k, n in knapsack({k: n - take[k] for k, n in counts.items() if n > take[k]}, room).items():
            take[k] += n
    return Share(source, rounds, {k: n for k, n in take.items() if n}, rounds * whole + sum(k * n for k, n in take.items()))


def feasible(wanted: list, histogram: dict[str, dict[int, int]]) -> int:
    """The largest total at which each source with text and a share can have it within its cap; 0 without such."""
    most = {s: m * sum(k * n for k, n in histogram.get(s, {}).items()) for s, _, m in wanted if m}
    return int(min((most[s] / share for s, share, _ in wanted if share and most.get(s)), default=0))


def _fitted(sized: DataFrame, targets: DataFrame, total: int | str | None) -> tuple[list, list[Share], int]:
    wanted = sorted({(r.source, r.target_share, r.max_repeats) for r in targets.filter("source IS NOT NULL").collect()}, key=str)  # a short list of sources
    names = F.broadcast(targets.select("source").distinct())
    histogram: dict[str, dict[int, int]] = {}
    for r in sized.join(names, "source").groupBy("source", "n_tokens").count().collect():  # sources with a target by distinct lengths
        histogram.setdefault(r.source, {})[r.n_tokens] = r["count"]
    total = feasible(wanted, histogram) if total == FEASIBLE else total or sized.agg(F.sum("n_tokens")).first()[0] or 0
    return wanted, [fit(s, histogram.get(s, {}), int(total * (share or 0)), m or 0) for s, share, m in wanted], total


def selection(documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, copies of the selected documents.

    ``total`` is the size of the mix in tokens, by default that of the corpus, or FEASIBLE. Sources without a
    target, null sources and empty texts are not used; a source with too little text is used
    max_repeats times over and stays below its share; an absent one has no rows.
    """
    sized = with_tokens(documents, "source", path=path)
    return _selected(sized, _fitted(sized, targets, total)[1], seed)


def _selected(sized: DataFrame, fits: list[Share], seed: int) -> DataFrame:
    spark = sized.sparkSession
    rounds = [(f.source, f.rounds) for f in fits]
    takes = [(f.source, k, n) for f in fits for k, n in f.take.items()]
    rounds_ = F.broadcast(spark.createDataFrame(rounds, "source string, rounds int"))  # a row for each source with a target
    takes_ = spark.createDataFrame(takes, "source string, n_tokens bigint, take bigint")
    hashed = sized.filter("n_tokens > 0").join(rounds_, "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    n = parts(sized)
    order = ranked(hashed.withColumn("salt", F.pmod("h", F.lit(n)).cast("int")), ["source", "n_tokens"], "h", "doc_id")
    copies = F.col("rounds") + F.when(F.col("rank") < F.coalesce("take", F.lit(0)), 1).otherwise(0)
    return order.join(takes_, ["source", "n_tokens"], "left").select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """source, target_share, max_repeats, n_docs, n_copies, tokens, actual_share, share_of_asked of every target.

    actual_share is that of the tokens of the mix, share_of_asked that of the total asked for.
    """
    sized = with_tokens(documents, "source", path=path)
    _, fits, asked = _fitted(sized, targets, total)
    used = _selected(sized, fits, seed)
    own = used.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = own.agg(F.sum("tokens").alias("whole")).first()[0] or 1
    out = targets.select("source", "target_share", "max_repeats").join(own, "source", "left").fillna(0, ["n_docs", "n_copies", "tokens"])
    return out.withColumn("actual_share", F.col("tokens") / F.lit(float(whole))).withColumn("share_of_asked", F.col("tokens") / F.lit(float(asked or 1)))
