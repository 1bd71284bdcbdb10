"""Deduplicating new batches against everything accepted so far.

The history is a folder. Each load adds to it what belongs to its own batch: the blocking keys of the
accepted records (hash of the payload; minimum-hash bands of five-word shingles within the site) in a
table bucketed by key, their words and scored fields in small segments, the records and whom they
belong to, and the counts that the weights of evidence are learnt from. A new batch probes the key
table, which is narrow and not shuffled, and reads those segments alone that hold a candidate; nothing
of the history is parsed, sorted, compared or written again.

Candidate pairs are scored by weights of evidence for the agreement of their fields (bands, path,
digest, date), learnt from the pairs decided so far. Pairs that score clearly higher than any pair of
different records did, or clearly lower than any pair of the same, are decided by the score; between
these limits, and until enough pairs were seen, the words in order are compared.

What repeats nothing old is compared inside the batch in rounds: in each, the records that lead all of
their keys are accepted, and those that share a key with one of them are compared with it. So no key's
group is ever paired with itself, and a group of near copies costs one comparison each.

A refused record belongs to the cluster of the accepted record it repeats. One that repeats several
joins their clusters: union-find over the representatives concerned, others stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.pages import columns, header, page_text, site_of, text_lines

SAME = 0.9
WORDS, BANDS, ROWS = 5, 24, 5
_rng = np.random.default_rng(2)
_FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_TERMS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at a time, so that memory does not grow with the text.
PIECE = 4096
_codes: dict[str, int] = {}


def word_codes(words: list[str]) -> np.ndarray:
    """32-bit codes of words."""
    out = np.empty(len(words), np.uint32)
    for k, w in enumerate(words):
        c = _codes.get(w)
        if c is None:
            c = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            if len(_codes) < 400_000:
                _codes[w] = c
        out[k] = c
    return out


def band_keys(codes: np.ndarray, salt: int) -> np.ndarray:
    """Keys of the bands of a text within a site. A text shorter than a shingle is one shingle."""
    a = codes.astype(np.uint64)
    if len(a) < WORDS:
        a = np.concatenate([a, np.zeros(WORDS - len(a), np.uint64)])
    with np.errstate(over="ignore"):
        h = np.zeros(len(a) - WORDS + 1, np.uint64)
        for j in range(WORDS):
            h = (h ^ a[j : len(a) - WORDS + 1 + j]) * _MIX
            h ^= h >> np.uint64(29)
        least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
        for at in range(0, len(h), PIECE):
            x = h[at : at + PIECE, None] * _FACTORS + _TERMS
            least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(0))
        keys = np.full(BANDS, np.uint64(salt))
        for r in range(ROWS):
            keys = (keys ^ least[r::ROWS]) * _MIX
            keys ^= keys >> np.uint64(32)
        keys = keys * _MIX + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    n = min(len(a), len(b))
    differ = np.nonzero(a[:n] != b[:n])[0]
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.nonzero(a[::-1][:n] != b[::-1][:n])[0]
        tail = int(differ[0]) if len(differ) else n
        if tail:
            a, b, head = a[:-tail], b[:-tail], head + tail
    if not len(a) or not len(b):
        return head
    place: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        place[w] = place.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & place.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return head + len(a) - v.bit_count()


def same_words(a: bytes | None, b: bytes | None) -> bool:
    """Whether nine tenths of the words are the same in order; texts without words never are."""
    if not a or not b:
        return False
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    most = max(len(x), len(y))
    return min(len(x), len(y)) >= SAME * most and common_words(x, y) >= SAME * most


FEATURES = "record_seq bigint, batch_no int, site string, path string, day string, declared string, h1 bigint, h2 bigint, keys array<bigint>, words binary"


def features(records: DataFrame) -> DataFrame:
    """What is compared of each response record with a payload: hash of the payload, blocking keys (that of the hash and, of pages, those of the bands) and words."""
    workspace.small_batches(records.sparkSession)
    kind = header("http_headers", "Content-Type")
    mime = F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))))
    uri = header("rec_headers", "WARC-Target-URI")
    rows = records.filter((F.col("rec_type") == "response") & (F.length("payload") > 0)).select(
        "record_seq",
        F.coalesce("batch_no", F.lit(0)).alias("batch_no"),
        site_of(uri).alias("site"),
        F.regexp_extract(uri, r"://[^/]*([^?#>]*)", 1).alias("path"),
        F.substring(header("rec_headers", "WARC-Date"), 1, 10).alias("day"),
        header("rec_headers", "WARC-Payload-Digest").alias("declared"),
        (kind.isNull() | (mime == "") | (mime == "text/html")).alias("is_page"),
        kind.alias("ctype"),
        header("http_headers", "Transfer-Encoding").alias("te"),
        header("http_headers", "Content-Encoding").alias("ce"),
        "payload",
    )
    kept = ["record_seq", "batch_no", "site", "path", "day", "declared"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, keys, words = [], [], [], []
            for site, is_page, ctype, te, ce, payload in columns(batch, "site", "is_page", "ctype", "te", "ce", "payload"):
                h = xxhash.xxh3_128_digest(payload)
                h1.append(int.from_bytes(h[:8], "big", signed=True))
                h2.append(int.from_bytes(h[8:], "big", signed=True))
                codes = word_codes(" ".join(t for _, t in text_lines(page_text(payload, ctype, te, ce))).lower().split()) if is_page else ()
                of_hash = h1[-1] ^ (h2[-1] >> 1)
                if len(codes) and site is not None:
                    keys.append([of_hash, *band_keys(codes, xxhash.xxh3_64_intdigest(site.encode())).tolist()])
                    words.append(codes.tobytes())
                else:
                    keys.append([of_hash])
                    words.append(None)
            arrays = [*batch.select(kept).columns, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "h1", "h2", "keys", "words"])

    return rows.mapInArrow(part, FEATURES)


#: Fields that are scored, as agreement levels of a candidate pair.
EVIDENCE = ("bands", "path", "declared", "day")


def _levels() -> list[Column]:
    """Agreement levels 0-3 of a pair of rows a_* and b_*."""
    path = F.levenshtein("a_path", "b_path") / F.greatest(F.length("a_path"), F.length("b_path"), F.lit(1))
    return [
        F.least(F.lit(3), F.floor(F.col("n_keys") * 4 / BANDS)).cast("int").alias("bands"),
        F.coalesce(F.when(F.col("a_path") == F.col("b_path"), 3).when(path < 0.3, 2).when(path < 0.6, 1).otherwise(0), F.lit(0)).alias("path"),
        F.coalesce((F.col("a_declared") == F.col("b_declared")).cast("int"), F.lit(2)).alias("declared"),
        F.coalesce((F.col("a_day") == F.col("b_day")).cast("int"), F.lit(2)).alias("day"),
    ]


#: Decided pairs before the score decides any, and by how much (in nats) it must be beyond what was seen.
LEARNT, MARGIN = 500, 1.0


class History:
    """Accepted records, kept below a folder; give the same folder and the names of its loads again to go on.

    ``buckets`` and ``segments`` (of each load) are to grow with the history and the batches; buckets are fixed with the folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, loads: list[str] | None = None, buckets: int = 16, segments: int = 16) -> None:
        self.spark = spark
        self.folder = folder or workspace.fresh_path(spark, "history")
        self.loads = list(loads or [])
        self.segments = segments
        self._table = f"quarry_keys_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"
        if not spark.catalog.tableExists(self._table):
            spark.sql(f"CREATE TABLE {self._table} (key BIGINT, other BIGINT, load STRING) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{self.folder}/keys'")
        self._buckets = buckets
        #: how many decided pairs had these levels of agreement, and were the same or not
        self.counts: dict[tuple[int, ...], list[int]] = {}
        if self.loads:
            self.counts = {tuple(levels): n for levels, n in json.loads(workspace.read_text(spark, f"{self.folder}/counts/{self.loads[-1]}.json"))}

    def _read(self, name: str, loads: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/{x}" for x in loads))

    def keys(self) -> DataFrame | None:
        """key, other, load of the accepted records of all loads."""
        return self.spark.table(self._table).filter(F.col("load").isin(self.loads)) if self.loads else None

    def segment(self, seq: str) -> Column:
        return F.pmod(F.xxhash64(seq), F.lit(self.segments)).cast("int")

    def texts(self, places: list[tuple[str, int]]) -> DataFrame:
        """What is compared of the accepted records in these segments."""
        return self.spark.read.schema(TEXTS).parquet(*(f"{self.folder}/texts/load={load}/segment={k}" for load, k in places))

    def weights(self) -> dict[tuple[str, int], float]:
        """Weight of evidence of each field's level, from the pairs decided so far."""
        total = [sum(c[side] for c in self.counts.values()) for side in (0, 1)]
        out = {}
        for k, f in enumerate(EVIDENCE):
            for level in range(4):
                no, yes = (sum(c[side] for levels, c in self.counts.items() if levels[k] == level) for side in (0, 1))
                out[f, level] = math.log((yes + 0.5) / (total[1] + 2)) - math.log((no + 0.5) / (total[0] + 2))
        return out

    def limits(self) -> tuple[float, float]:
        """Scores below the first are of different records, above the second of the same."""
        n = [sum(c[side] for c in self.counts.values()) for side in (0, 1)]
        if min(n) < LEARNT:
            return -math.inf, math.inf
        weight = self.weights()
        score = {levels: sum(weight[f, k] for f, k in zip(EVIDENCE, levels)) for levels in self.counts}
        return min(score[x] for x, c in self.counts.items() if c[1]) - MARGIN, max(score[x] for x, c in self.counts.items() if c[0]) + MARGIN

    def learn(self, pairs: DataFrame) -> None:
        """Count pairs whose words were compared."""
        for r in pairs.filter("compared").groupBy("same", *EVIDENCE).count().collect():  # at most as many rows as combinations of levels
            self.counts.setdefault(tuple(r[f] for f in EVIDENCE), [0, 0])[r.same] += r["count"]

    def add(self, accepted: DataFrame, load: str) -> None:
        """Append the accepted records of a load."""
        rows = accepted.withColumn("load", F.lit(load))
        rows.select(F.explode("keys").alias("key"), F.col("record_seq").alias("other"), "load").repartition(self._buckets, "key").write.insertInto(self._table)
        placed = accepted.select(*TEXTS_COLUMNS, self.segment("record_seq").alias("segment"))
        placed.repartition("segment").write.option("compression", "zstd").mode("overwrite").partitionBy("segment").parquet(f"{self.folder}/texts/load={load}")
        workspace.write_text(self.spark, f"{self.folder}/counts/{load}.json", json.dumps(list(self.counts.items())))
        self.loads.append(load)

    def answer(self, refused: DataFrame, links: DataFrame, load: str) -> DataFrame:
        """Note whom the refused records of a load belong to, and join the clusters that links (a, b) connect."""
        path = f"{self.folder}/refused/{load}"
        refused.write.option("compression", "zstd").mode("overwrite").parquet(path)
        links, n = workspace.counted(links, "links")
        if n:
            ends = links.select(F.col("a").alias("record_seq")).unionByName(links.select(F.col("b").alias("record_seq"))).distinct()
            concerned = self.rooted(ends)
            both = merged(concerned, links).join(concerned.select("record_seq", F.col("representative").alias("was")), "record_seq")
            up = both.select("record_seq", "representative").unionByName(both.select(F.col("was").alias("record_seq"), "representative")).filter("record_seq <> representative")
            up.groupBy("record_seq").agg(F.min("representative").alias("representative")).write.option("compression", "zstd").mode("overwrite").parquet(f"{self.folder}/roots/{load}")
        return self.spark.read.schema(REFUSED).parquet(path)

    def _roots(self) -> DataFrame | None:
        loads = [x for x in self.loads if workspace.exists(self.spark, f"{self.folder}/roots/{x}/_SUCCESS")]
        return self._read("roots", loads, ROOTS).groupBy("record_seq").agg(F.min("representative").alias("up")) if loads else None

    def rooted(self, records: DataFrame) -> DataFrame:
        """record_seq, representative of accepted records: the pointers of joined clusters, followed to the root."""
        at = records.select("record_seq", F.col("record_seq").alias("representative"))
        roots = self._roots()
        while roots is not None:
            step = at.join(roots.select(F.col("record_seq").alias("of"), "up"), F.col("representative") == F.col("of"), "left")
            at = workspace.written(step.select("record_seq", F.coalesce("up", "representative").alias("representative"), F.col("up").isNotNull().alias("moved")), "rooted")
            if not at.filter("moved").limit(1).count():
                break
        return at.select("record_seq", "representative")

    def representatives(self) -> DataFrame:
        """record_seq, representative of every record of all loads."""
        if not self.loads:
            return self.spark.createDataFrame([], ROOTS)
        texts = self.spark.read.schema("record_seq bigint, load string, segment int").parquet(f"{self.folder}/texts")
        heads = self.rooted(texts.filter(F.col("load").isin(self.loads)).select("record_seq"))
        refused = self._read("refused", self.loads, REFUSED).select(F.col("duplicate_seq").alias("refused_seq"), F.col("accepted_seq").alias("record_seq"))
        return heads.unionByName(refused.join(heads, "record_seq").select(F.col("refused_seq").alias("record_seq"), "representative"))


TEXTS = "record_seq bigint, path string, day string, declared string, h1 bigint, h2 bigint, words binary"
TEXTS_COLUMNS = [x.split()[0] for x in TEXTS.split(", ")]
ROOTS = "record_seq bigint, representative bigint"


def _few(ids: DataFrame, n: int) -> DataFrame:
    """ids of n rows, to be broadcast if they are as small as the session allows; else the join shuffles."""
    return F.broadcast(ids) if 16 * n <= int(ids.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) else ids


DECIDED = "seq bigint, other bigint, exact boolean, bands int, path int, declared int, day int, same boolean, compared boolean, score double"


def compared(pairs: DataFrame, n: int, mine: DataFrame, theirs: DataFrame, history: History) -> DataFrame:
    """Of n pairs (seq in mine, other in theirs, n_keys): their evidence and score, whether they are exact copies, and whether the same.

    What comes out is written to the shared folder. Only texts of candidates are shuffled.
    """
    fields = ("path", "day", "declared", "h1", "h2", "words")

    def side(rows: DataFrame, name: str, mark: str) -> DataFrame:
        ids = pairs.select(F.col(name).alias("record_seq")).distinct()
        return rows.join(_few(ids, n), "record_seq", "left_semi").select(F.col("record_seq").alias(name), *(F.col(f).alias(f"{mark}_{f}") for f in fields))

    weight = history.weights()
    low, high = history.limits()
    exact = (F.col("a_h1") == F.col("b_h1")) & (F.col("a_h2") == F.col("b_h2"))
    levels = pairs.join(side(mine, "seq", "a"), "seq").join(side(theirs, "other", "b"), "other").select("seq", "other", exact.alias("exact"), *_levels(), "a_words", "b_words")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # weights are used here and not in an expression, whose code would be compiled anew for each batch
            same, read, score = [], [], []
            for e, x, y, *levels_ in columns(batch, "exact", "a_words", "b_words", *EVIDENCE):
                points = sum(weight[f, k] for f, k in zip(EVIDENCE, levels_))
                open_ = not e and low <= points <= high
                both = x is not None and y is not None  # of records without words only exact copies are the same
                same.append(e or (same_words(x, y) if open_ else both and points > high))
                read.append(open_)
                score.append(points)
            kept = batch.drop_columns(["a_words", "b_words"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(same, pa.bool_()), pa.array(read, pa.bool_()), pa.array(score, pa.float64())], [*kept.schema.names, "same", "compared", "score"])

    return workspace.written(levels.mapInArrow(part, DECIDED), "pairs")


def _best(matches: DataFrame) -> DataFrame:
    """accepted_seq, duplicate_seq, exact, score: of the records one repeats, an exact copy before others, then the first."""
    best = matches.groupBy("seq").agg(F.min_by(F.struct("other", "exact", "score"), F.struct(~F.col("exact"), "other")).alias("best"))
    return best.select(F.col("best.other").alias("accepted_seq"), F.col("seq").alias("duplicate_seq"), "best.exact", "best.score")


def copies_of(batch: DataFrame) -> tuple[DataFrame, int]:
    """(record_seq, lead of the records that are not the first of their payload on their site in their batch, written; how many)."""
    first = batch.groupBy("h1", "h2", "site").agg(F.min("record_seq").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    same = [F.col(f"batch.{c}").eqNullSafe(F.col(f"first.{c}")) for c in ("h1", "h2", "site")]
    rows = batch.select("h1", "h2", "site", "record_seq").alias("batch").join(first.alias("first"), same).filter("record_seq <> lead")
    return workspace.counted(rows.select("record_seq", "lead"), "copies")


def _of_history(heads: DataFrame, history: History) -> DataFrame | None:
    """Decided pairs of the heads of a batch and accepted records."""
    held = history.keys()
    if held is None:
        return None
    mine = heads.select(F.explode("keys").alias("key"), F.col("record_seq").alias("seq"))
    met = mine.join(held, "key").groupBy("seq", "other").agg(F.count("*").alias("n_keys"), F.first("load").alias("load"))
    placed = met.withColumn("segment", history.segment("other"))
    pairs, seen = workspace.observed(placed, "candidates", n=F.count(F.lit(1)), places=F.collect_set(F.struct("load", "segment")))  # folders, not records
    if not seen["n"]:
        return None
    return compared(pairs.drop("load", "segment"), seen["n"], heads, history.texts([(r["load"], r["segment"]) for r in seen["places"]]), history)


def refuse(batch: DataFrame, history: History, name: str) -> DataFrame:
    """accepted_seq, duplicate_seq, exact, score of the refused records of a batch; the accepted ones join the history as load name.

    ``batch`` holds features(), written. Records are taken by record_seq. A record of null site or
    without words can only be an exact copy. Equal record_seq are one record.
    """
    spark = batch.sparkSession
    copies, n_copies = copies_of(batch)
    # copies of one payload on one site share one fate: the first stands for them
    heads = batch.join(_few(copies.select("record_seq"), n_copies), "record_seq", "left_anti")
    answers: list[DataFrame] = []
    learnt: list[DataFrame] = []
    n_refused = 0
    open_ = heads.select("record_seq", "keys")
    pairs = _of_history(heads, history)
    if pairs is not None:
        learnt.append(pairs)
        hit, n_refused = workspace.counted(_best(pairs.filter("same")), "refused")
        answers.append(hit)
        open_ = open_.join(_few(hit.select(F.col("duplicate_seq").alias("record_seq")), n_refused), "record_seq", "left_anti")
    while True:
        mine = open_.select(F.explode("keys").alias("key"), F.col("record_seq").alias("seq"))
        leads = mine.groupBy("key").agg(F.min("seq").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
        meets = mine.join(leads, "key").filter("seq <> other").groupBy("seq", "other").agg(F.count("*").alias("n_keys"))
        candidates, n = workspace.counted(meets, "candidates")
        if not n:
            break
        pairs = compared(candidates, n, heads, heads, history)
        learnt.append(pairs)
        behind = candidates.select(F.col("seq").alias("record_seq")).distinct()
        # those that lead all of their keys are accepted: what matches them is refused
        sure = pairs.filter("same").join(behind, F.col("other") == F.col("record_seq"), "left_anti")
        hit, n_hit = workspace.counted(_best(sure), "refused")
        answers.append(hit)
        n_refused += n_hit
        left = behind.join(hit.select(F.col("duplicate_seq").alias("record_seq")), "record_seq", "left_anti")
        open_, n_open = workspace.counted(heads.select("record_seq", "keys").join(_few(left, n), "record_seq", "left_semi"), "open")
        if not n_open:
            break
    refused = answers[0] if answers else spark.createDataFrame([], REFUSED)
    for more in answers[1:]:
        refused = refused.unionByName(more)
    decided = learnt[0] if learnt else spark.createDataFrame([], DECIDED)
    for more in learnt[1:]:
        decided = decided.unionByName(more)
    history.learn(decided)
    accepted = heads.join(_few(refused.select(F.col("duplicate_seq").alias("record_seq")), n_refused), "record_seq", "left_anti")
    history.add(accepted, name)
    # whom else a refused record repeats, if that one was accepted
    others = decided.filter("same").join(refused.select(F.col("duplicate_seq").alias("seq"), F.col("accepted_seq").alias("b")), "seq").filter("other <> b").select(F.col("other").alias("a"), "b")
    links = others.join(_few(refused.select(F.col("duplicate_seq").alias("a")), n_refused), "a", "left_anti").distinct()
    return history.answer(with_copies(copies, refused), links, name)


def with_copies(copies: DataFrame, refused: DataFrame) -> DataFrame:
    """The answers of the heads, and of their copies: those go to the head, or to what it repeats."""
    of_head = refused.select(F.col("duplicate_seq").alias("lead"), F.col("accepted_seq").alias("of_lead"), F.col("exact").alias("of_exact"))
    also = copies.join(of_head, "lead", "left").select(
        F.coalesce("of_lead", "lead").alias("accepted_seq"), F.col("record_seq").alias("duplicate_seq"), F.coalesce("of_exact", F.lit(True)).alias("exact"), F.lit(None).cast("double").alias("score")
    )
    return refused.unionByName(also)


REFUSED = "accepted_seq bigint, duplicate_seq bigint, exact boolean, score double"


def loads(batches: list[tuple[int, int, int]], together: int) -> list[list[int]]:
    """Numbers of the batches of each load, of batches as (number, first, last record); batches whose records cross are not taken together."""
    out: list[list[int]] = []
    last = None
    for number, first, end in sorted(batches):
        if out and len(out[-1]) < together and last is not None and first > last:
            out[-1].append(number)
        else:
            out.append([number])
        last = max(end, last or end)
    return out


def deduplicated(records: DataFrame, history: History | None = None, together: int = 1) -> DataFrame:
    """accepted_seq, duplicate_seq, exact, score over all batches of records, one after the other.

    ``together`` is how many waiting batches are taken in one load. Records without payload and of
    other types are left out; a null batch comes first. Records of an equal record_seq are one. Extra
    columns are ignored.
    """
    spark = records.sparkSession
    history = history or History(spark)
    path = workspace.fresh_path(spark, "features")
    features(records).write.option("compression", "zstd").partitionBy("batch_no").parquet(path)
    everything = spark.read.schema(FEATURES).parquet(path)
    waiting = everything.groupBy("batch_no").agg(F.min("record_seq").alias("first"), F.max("record_seq").alias("last")).collect()  # a row for each batch
    answers: DataFrame | None = None
    for numbers in loads([tuple(r) for r in waiting], together):
        now = refuse(everything.filter(F.col("batch_no").isin(numbers)), history, f"batch-{numbers[0]}")
        answers = now if answers is None else answers.unionByName(now)
    return answers if answers is not None else spark.createDataFrame([], REFUSED)


def merged(representatives: DataFrame, links: DataFrame) -> DataFrame:
    """record_seq, representative after links (a, b) joined clusters; roots are the least record of a cluster.

    Union-find by min-label hooking and path halving over the roots the links concern; all other rows stay.
    """
    roots = representatives.select(F.col("record_seq").alias("r"), F.col("representative").alias("root"))
    at = links.join(roots.withColumnRenamed("r", "a").withColumnRenamed("root", "ra"), "a", "left").join(roots.withColumnRenamed("r", "b").withColumnRenamed("root", "rb"), "b", "left")
    edges = workspace.written(at.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = workspace.written(both.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("theirs")), "y").groupBy("x").agg(F.min("theirs").alias("least"))
        hooked = labels.join(near, "x").select("x", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jumped = hooked.join(hooked.select(F.col("x").alias("label"), F.col("label").alias("next")), "label", "left").select("x", F.coalesce("next", "label").alias("label"), "was")
        step = workspace.written(jumped, "labels")
        changed = step.filter("label <> was").limit(1).count()
        labels = step.select("x", "label")
        if not changed:
            break
    new = labels.select(F.col("x").alias("old"), "label")
    return representatives.join(new, F.col("representative") == F.col("old"), "left").select("record_seq", F.coalesce("label", "representative").alias("representative"))
