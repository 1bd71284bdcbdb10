"""Subject areas of documents.

A multi-pattern automaton finds the curated terms of all subjects in one pass over a text, the
longest term winning where several start or overlap. Each mention weighs as much as its term was
given in the list, times its rarity in the corpus, times the evidence of the labels: the share of the
labelled documents with the term that readers gave its subject. A subject's score is the sum of its
mentions over the length of the text. A subject is assigned if its score passes its threshold: the one
with the best F1 over the labelled documents, those of other subjects included, which are the
negatives. So a remark in passing falls below it.

Terms are a parameter (the file subject_terms.txt by default); what is shipped to the workers is as
large as that list, and what is collected as large as the list, or a histogram of scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.pages import columns

#: Labels of a subject (or, if fewer, of all subjects together) that calibrate its threshold; else that many mentions decide.
FEWEST, MENTIONS = 20, 2
#: Evidence of a term no labelled document has, and how many documents that counts as.
BELIEF, DOCUMENTS = 0.8, 5
#: Step of the histogram of scores from which thresholds are taken, as a factor.
STEP = 1.02
#: Words of a text beyond which length counts.
SHORT = 50


def curated_terms(text: str | None = None) -> dict[str, tuple[str, float]]:
    """term in lower case -> (subject, weight). A term of two subjects belongs to the first."""
    if text is None:
        text = files("quarry.llm").joinpath("subject_terms.txt").read_text("utf-8")
    out: dict[str, tuple[str, float]] = {}
    for line in text.splitlines():
        if ":" not in line or line.startswith("#"):
            continue
        subject, _, terms = line.partition(":")
        for term in terms.split(","):
            name, _, weight = term.partition("=")
            if name.strip():
                out.setdefault(" ".join(name.lower().split()), (subject.strip(), float(weight or 1)))
    return out


def automaton(terms: list[str]):
    import ahocorasick

    tool = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        tool.add_word(term, (len(term), k))
    tool.make_automaton()
    return tool


def matches(tool, text: str) -> Counter:
    """Number of a term -> its occurrences as whole words; of overlapping terms the longest counts."""
    low = " ".join(text.lower().replace("'", "’").split())
    out: Counter = Counter()
    for end, (length, k) in tool.iter_long(low):
        start = end - length + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            out[k] += 1
    return out


def mentions(documents: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n_words, mentions (term number, n) of all documents, written to the shared folder."""
    workspace.small_batches(documents.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(terms)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("mentions", pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())])))])
        for batch in batches:
            rows = []
            for doc_id, text in columns(batch, "doc_id", "text"):
                text = text or ""
                rows.append({"doc_id": doc_id, "n_words": len(text.split()), "mentions": [{"term": k, "n": n} for k, n in matches(tool, text).items()]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    got = documents.select("doc_id", "text").mapInArrow(part, "doc_id bigint, n_words bigint, mentions array<struct<term: int, n: int>>")
    return workspace.written(got, "mentions")


def term_weights(found: DataFrame, terms: list[str], curated: dict[str, tuple[str, float]], labels: DataFrame | None = None) -> dict[int, float]:
    """Weight of a mention of each term: that of the list, by rarity and by the evidence of labels."""
    seen = {r.term: r["count"] for r in found.select(F.explode("mentions.term").alias("term")).groupBy("term").count().collect()}  # as many rows as terms
    n_docs = max(found.count(), 1)
    evidence: dict[int, tuple[int, int]] = {}
    if labels is not None:
        subjects = F.broadcast(found.sparkSession.createDataFrame([(k, curated[t][0]) for k, t in enumerate(terms)], "term int, subject string"))  # as many rows as terms
        held = _held(labels)
        read = found.join(held.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("mentions.term").alias("term")).distinct().join(subjects, "term")
        given = read.join(held.withColumn("given", F.lit(1)), ["doc_id", "subject"], "left")
        evidence = {r.term: (r.n, r.n_given) for r in given.groupBy("term").agg(F.count("*").alias("n"), F.count("given").alias("n_given")).collect()}  # as many rows as terms
    out = {}
    for k, t in enumerate(terms):
        n, n_given = evidence.get(k, (0, 0))
        out[k] = curated[t][1] * (1 + math.log((n_docs + 1) / (seen.get(k, 0) + 1))) * (n_given + DOCUMENTS * BELIEF) / (n + DOCUMENTS)
    return out


def _held(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", "subject").distinct()


def scores(found: DataFrame, terms: list[str], curated: dict[str, tuple[str, float]], weights: dict[int, float]) -> DataFrame:
    """doc_id, subject, n_mentions, score of every subject with a mention."""
    rows = [(k, curated[t][0], weights[k]) for k, t in enumerate(terms)]
    table = F.broadcast(found.sparkSession.createDataFrame(rows, "term int, subject string, weight double"))  # as many rows as terms
    return (
        found.select("doc_id", "n_words", F.explode("mentions").alias("m"))
        .select("doc_id", "n_words", "m.term", "m.n")
        .join(table, "term")
        .groupBy("doc_id", "subject")
        .agg(F.sum("n").alias("n_mentions"), (F.sum(F.col("n") * F.col("weight")) / (1 + F.log1p(F.max("n_words") / SHORT))).alias("score"))
    )


def best_threshold(positive: dict[int, int], negative: dict[int, int], missed: int) -> float:
    """The threshold with the best F1, of counts by step of the score; ties go to the middle of the widest gap.

    ``missed`` positives have no score at all.
    """
    steps = sorted({*positive, *negative})
    tp, fp, total = sum(positive.values()), sum(negative.values()), sum(positive.values()) + missed
    best, low, high = -1.0, 0.0, 0.0
    before = steps[0] - 2 if steps else 0
    for step in steps:
        f1 = 2 * tp / (tp + fp + total) if total else 0.0
        if f1 > best + 1e-12 or (f1 > best - 1e-12 and step - before > high - low):
            best, low, high = max(best, f1), before, step
        tp, fp, before = tp - positive.get(step, 0), fp - negative.get(step, 0), step
    return STEP ** ((low + 1 + high) / 2)


def thresholds(scored: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float | None]:
    """(threshold of each subject with FEWEST labels, that of all others; null with too few labels at all)."""
    held = _held(labels).withColumn("given", F.lit(True))
    known = held.select("doc_id").distinct()
    rated = scored.join(known, "doc_id", "left_semi").select("doc_id", "subject", F.floor(F.log("score") / math.log(STEP)).cast("int").alias("step"))
    both = rated.join(held, ["doc_id", "subject"], "full")
    counts = both.groupBy("subject", "step", "given").count().collect()  # as many rows as subjects and steps of the histogram
    sides: dict[str | None, tuple[Counter, Counter]] = {}
    for r in counts:
        for key in (r.subject, None):
            positive, negative = sides.setdefault(key, (Counter(), Counter()))
            (positive if r.given else negative)[r.step] += r["count"]

    def of(key: str | None) -> float | None:
        positive, negative = sides.get(key, (Counter(), Counter()))
        missed = positive.get(None, 0)
        if sum(positive.values()) < FEWEST:
            return None
        return best_threshold({k: n for k, n in positive.items() if k is not None}, {k: n for k, n in negative.items() if k is not None}, missed)

    return {s: t for s in sides if s is not None and (t := of(s)) is not None}, of(None)


def document_subjects(documents: DataFrame, labels: DataFrame | None = None, curated: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """doc_id, subject, n_mentions, score of the subjects of each document.

    Null and empty texts have no subject. Repeated texts are scored one by one; a doc_id that comes
    twice is scored over both texts. Extra columns are ignored; without labels, or with fewer than
    FEWEST of all subjects together, MENTIONS decide.
    """
    curated = curated or curated_terms()
    terms = sorted(curated)
    found = mentions(documents, terms)
    scored = workspace.written(scores(found, terms, curated, term_weights(found, terms, curated, labels)), "scores")
    own, other = thresholds(scored, labels) if labels is not None else ({}, None)
    if other is None:
        return scored.filter(F.col("n_mentions") >= MENTIONS)
    least = F.lit(other)
    for subject, low in sorted(own.items()):
        least = F.when(F.col("subject") == subject, F.lit(low)).otherwise(least)
    return scored.filter(F.col("score") >= least)


def composition(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """subject, n_docs, share of the corpus by subject; a document of several subjects counts in each by its part."""
    each = subjects.groupBy("doc_id").agg(F.collect_set("subject").alias("own"))  # a set of subjects, of which there are few
    total = max(documents.count(), 1)
    parts = each.select(F.explode("own").alias("subject"), (1 / F.size("own")).alias("part"))
    return parts.groupBy("subject").agg(F.count("*").alias("n_docs"), (F.sum("part") / total).alias("share"))
