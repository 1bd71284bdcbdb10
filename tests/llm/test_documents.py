"""Containers, mixing and subjects."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import tokens
from quarry.llm.containers import best_fit, bucket_boundaries, by_buckets, filled, oversized
from quarry.llm.mixing import FEASIBLE, feasible, fit, knapsack, selection, shares
from quarry.llm.subjects import automaton, best_threshold, composition, curated_terms, document_subjects, matches

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25), st.integers(60, 120))
def test_plans(histogram, capacity):
    for plan in (best_fit, by_buckets):
        placements, used = plan(histogram, capacity)
        _check_plan(histogram, capacity, placements, used)
    total = sum(k * n for k, n in histogram.items())
    assert best_fit(histogram, capacity)[1] <= 2 * -(-total // capacity) + 1
    # a batch inside a bucket holds as many items as fit if each is as long as the bound
    low, containers = 0, 0
    for high in bucket_boundaries(histogram):
        containers += -(-sum(n for k, n in histogram.items() if low < k <= high) // (capacity // high))
        low = high
    assert by_buckets(histogram, capacity)[1] == containers


def _check_plan(histogram, capacity, placements, used):
    load: defaultdict = defaultdict(int)
    taken: Counter = Counter()
    for p in placements:
        for c in range(p.n):
            load[p.start + c] += p.length * p.each
        taken[p.length] += p.each * p.n
    assert taken == Counter(histogram) and all(v <= capacity for v in load.values()) and set(load) == set(range(used))
    for length in histogram:
        ranks = sorted((p.first, p.first + p.each * p.n) for p in placements if p.length == length)
        assert ranks[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), min_size=1, max_size=6), st.integers(1, 3))
def test_boundaries_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in histogram.items())

    best = min(padding((*c, lengths[-1])) for r in range(buckets) for c in combinations(lengths[:-1], r))
    assert padding(bucket_boundaries(histogram, buckets)) == best


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=5), st.integers(0, 120))
def test_knapsack(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1)}
    got = knapsack(counts, room)
    assert all(n <= counts[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 20), max_size=6), st.integers(0, 5000), st.integers(0, 6))
def test_fit(counts, budget, most):
    f = fit("s", counts, budget, most)
    assert f.tokens == f.rounds * sum(k * n for k, n in counts.items()) + sum(k * n for k, n in f.take.items())
    assert f.tokens <= max(budget, 0) and f.rounds + bool(f.take) <= max(most, 0) and all(n <= counts[k] for k, n in f.take.items())


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["apple", "stone", "river", "Ünïcode", "12"]) for _ in range(rng.choice([3, 3, 3, 10, 40, 120]))), rng.choice(["a", "a", "a", "b", None]), "extra", 5) for k in range(300)]
    rows += [(300, None, "a", "x", 1), (301, "", "a", "x", 1), (302, "same text", "b", "x", 1), (302, "same text", "b", "x", 1), (303, "word " * 5000, "c", "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, salt string, n_tokens int")


@needs_vocabulary
def test_long_texts_count_the_same():
    text = "Some words, and more of them; 12 numbers. Über alles\n\n " * 9000
    assert tokens.count_tokens(text) == len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(text))
    assert tokens.count_tokens("<|endoftext|>") > 1 and tokens.count_tokens("x" * 450_000) > 0


@needs_vocabulary
def test_filled(documents):
    placed = filled(documents, 100).collect()
    load: defaultdict = defaultdict(int)
    by_doc: defaultdict = defaultdict(list)
    for r in placed:
        load[r.container] += r.n_tokens
        by_doc[r.doc_id].append(r)
    sizes = {r.doc_id: r.n_tokens for r in tokens.with_tokens(documents).collect()}
    assert all(v <= 100 for v in load.values()) and set(by_doc) == {k for k, n in sizes.items() if n}
    assert all(len(v) == (2 if k == 302 else -(-sizes[k] // 100)) for k, v in by_doc.items())
    assert sum(load.values()) / (100 * len(load)) > 0.95
    assert {r.doc_id for r in oversized(filled(documents, 100)).collect()} == {k for k, n in sizes.items() if n > 100}
    pieces = sorted((r.first_token, r.n_tokens) for r in by_doc[303])
    assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and sum(p[1] for p in pieces) == sizes[303]
    assert filled(documents.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        filled(documents, 0)


@needs_vocabulary
def test_mixing(spark, documents):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("missing", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    total = 4000
    rows = selection(documents, targets, total).collect()
    used = Counter()
    for r in rows:
        used[r.source] += r.copies * r.n_tokens
        assert 1 <= r.copies <= {"a": 1, "b": 3}[r.source]
    assert used["a"] == 2000 and used["b"] == 1600
    assert sorted(map(tuple, selection(documents, targets, total).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, selection(documents, targets, total, seed=5).collect())) != sorted(map(tuple, rows))
    got = {r.source: r for r in shares(documents, targets, total).collect()}
    assert got["missing"].tokens == 0 and abs(got["a"].actual_share - 2000 / 3600) < 1e-9 and got["a"].n_copies == sum(r.copies for r in rows if r.source == "a")
    # the largest mix in which a and b keep their shares: a once over, or b three times
    sizes = Counter()
    for r in tokens.with_tokens(documents, "source").collect():
        sizes[r.source] += r.n_tokens
    most = int(min(sizes["a"] / 0.5, 3 * sizes["b"] / 0.4))
    got = {r.source: r for r in shares(documents, targets, FEASIBLE).collect()}
    assert abs(got["a"].share_of_asked - 0.5) < 0.01 and abs(got["b"].share_of_asked - 0.4) < 0.01
    assert feasible([("a", 0.5, 1), ("b", 0.4, 3), ("missing", 0.1, 2)], {"a": {1: sizes["a"]}, "b": {1: sizes["b"]}}) == most and feasible([], {}) == 0
    assert selection(documents.limit(0), targets).count() == 0 and shares(documents, targets.limit(0)).count() == 0


def test_matches():
    terms = ["bank", "river bank", "river bank loan", "café"]
    tool = automaton(terms)
    assert {terms[k]: n for k, n in matches(tool, "The River\n bank loan. A bank, banks; a river bank! CAFÉ").items()} == {"river bank loan": 1, "bank": 1, "river bank": 1, "café": 1}
    assert matches(tool, "") == {}


def test_subjects(spark):
    docs = spark.createDataFrame(
        [(1, "The jury heard the plaintiff. The verdict came late.", 1), (2, "It felt like a verdict. The compiler and the parser had a memory leak.", 1), (3, None, 1), (4, " \n", 1), (5, "nothing here", 1), (6, "A jury and a compiler; the plaintiff and the parser.", 1), (7, "jury " * 50_000, 1)],
        "doc_id bigint, text string, term int",
    )
    labels = spark.createDataFrame([(1, "law"), (1, "law"), (2, "food"), (None, "law"), (99, "law")], "doc_id bigint, subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(docs, labels).collect()}
    assert got == {(1, "law"), (2, "software"), (6, "law"), (6, "software"), (7, "law")}
    assert document_subjects(docs.limit(0), labels).count() == 0
    shares_ = {r.subject: (r.n_docs, r.share) for r in composition(docs, document_subjects(docs)).collect()}
    assert shares_ == {"law": (3, pytest.approx(2.5 / 7)), "software": (2, pytest.approx(1.5 / 7))}


def test_curated_terms():
    terms = curated_terms()
    assert len({s for s, _ in terms.values()}) == 10 and all(t == t.lower() for t in terms)
    assert curated_terms("x: a, b=2\n# no\ny: a") == {"a": ("x", 1.0), "b": ("x", 2.0)}


def test_thresholds_from_labels(spark):
    rows = [(k, "jury plaintiff verdict " + "word " * 20, 0) for k in range(40)] + [(100, "jury jury " + "word " * 3_000_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    labels = spark.createDataFrame([(k, "law") for k in range(40)], "doc_id bigint, subject string")
    got = {r.doc_id for r in document_subjects(docs, labels).collect()}
    assert got == set(range(40))


def test_passing_remarks_fall_below_the_threshold(spark):
    """Labelled documents of another subject are negatives: one remark is not enough, whatever the rarity of its term."""
    rows = [(k, "the jury heard the plaintiff and the verdict " * 2 + "word " * 20, 0) for k in range(30)]
    rows += [(100 + k, "the compiler and the parser had a memory leak " * 2 + "but the jury " + "word " * 20, 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    labels = spark.createDataFrame([(k, "law") for k in range(25)] + [(100 + k, "software") for k in range(25)] + [(110, "law")], "doc_id bigint, subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(docs, labels).collect()}
    assert got == {(k, "law") for k in range(30)} | {(100 + k, "software") for k in range(30)}


def test_best_threshold():
    assert 1.02**4 < best_threshold({10: 5, 12: 3}, {3: 9}, 1) < 1.02**10
    assert best_threshold({5: 10}, {}, 0) <= 1.02**5 and best_threshold({}, {}, 0) > 0
