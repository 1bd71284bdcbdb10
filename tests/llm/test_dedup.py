"""Deduplicating batches, against brute force."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.dedup import EVIDENCE, History, band_keys, common_words, deduplicated, features, loads, merged, refuse, same_words, word_codes
from quarry import workspace
from tests.llm.helpers import html, odd_rows, page, table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_words(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
    assert common_words(np.array(a, np.uint32), np.array(b, np.uint32)) == table_[-1][-1]


def test_keys_of_near_copies_meet():
    rng = random.Random(1)
    missed = 0
    for _ in range(200):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for k in rng.sample(range(300), 8):
            other[k] = "changed"
        a, b = band_keys(word_codes(words), 1), band_keys(word_codes(other), 1)
        missed += not (a == b).any()
    assert missed <= 2
    assert not (band_keys(word_codes(words), 1) == band_keys(word_codes(words), 2)).any()
    assert len(band_keys(word_codes(["one"]), 1)) == 24 and len(band_keys(word_codes([]), 1)) == 24


def _words(rng, n=200):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def _corpus(seed: int):
    """Rows, and of each record (order, site, words, payload)."""
    rng = random.Random(seed)
    rows, known, pool = [], [], []
    for seq in range(1, 121):
        batch = (seq - 1) // 30 + 1
        site = rng.choice(["a.example", "b.example"])
        how = rng.random()
        if pool and how < 0.25:
            base, _ = rng.choice(pool)
            words = list(base)
        elif pool and how < 0.55:
            base, site = rng.choice(pool)
            words = list(base)
            for k in rng.sample(range(len(words)), rng.randint(1, 3)):
                words[k] = f"x{rng.randrange(9)}"
        else:
            words = _words(rng)
        else_ = how >= 0.55 or not pool
        if else_:
            pool.append((words, site))  # copies are made of originals, so that they stay similar enough for the keys
        body = html(*(" ".join(words[k : k + 10]) for k in range(0, len(words), 10)))
        rows.append(page(seq, body, f"http://{site}/{seq}", batch=batch))
        known.append((seq, site, words, body))
    return rows, known


def _brute(known):
    accepted, out = [], {}
    for seq, site, words, body in known:
        hit = next((a for a in accepted if a[3] == body), None)
        near = [a for a in accepted if a[1] == site and common_words(word_codes(a[2]), word_codes(words)) >= 0.9 * max(len(a[2]), len(words))]
        if hit is not None:
            out[seq] = hit[0]
        elif near:
            out[seq] = near[0][0]
        else:
            accepted.append((seq, site, words, body))
    return out


def test_against_brute_force(spark):
    rows, known = _corpus(3)
    got = {r.duplicate_seq: r.accepted_seq for r in deduplicated(table(spark, [*rows, *odd_rows()])).collect()}
    want = _brute(known)
    assert {k: v for k, v in got.items() if k < 900} == want


def test_loads(spark):
    assert loads([(2, 5, 9), (1, 1, 4), (3, 10, 12), (4, 13, 20)], 3) == [[1, 2, 3], [4]]
    assert loads([(1, 1, 9), (2, 5, 12), (3, 13, 14)], 3) == [[1], [2, 3]] and loads([], 2) == []
    rows, known = _corpus(8)
    for together in (2, 4):
        got = {r.duplicate_seq: r.accepted_seq for r in deduplicated(table(spark, rows), together=together).collect()}
        assert got == _brute(known)


def test_many_copies_and_order_of_rows(spark):
    body = html("one two three four five six seven eight nine ten")
    rows = [page(k, body, f"http://s{k % 3}.example/", batch=1 + k % 2) for k in range(1, 41)]
    random.Random(0).shuffle(rows)
    got = {r.duplicate_seq: r.accepted_seq for r in deduplicated(table(spark, rows)).collect()}
    assert set(got) == set(range(1, 41)) - {2} and set(got.values()) == {2}


def test_history_goes_on(spark):
    rows, known = _corpus(5)
    history = History(spark)
    feats = workspace.written(features(table(spark, rows)), "features")
    first = refuse(feats.filter("batch_no <= 2"), history, "a").collect()
    again = History(spark, history.folder, ["a"])
    second = refuse(feats.filter("batch_no > 2"), again, "b").collect()
    assert {r.duplicate_seq for r in first} | {r.duplicate_seq for r in second} == set(_brute(known))
    assert History(spark, history.folder, ["a"]).weights() == history.weights() and history.counts
    assert {r.record_seq for r in again.representatives().collect()} == {x[0] for x in known}


def test_score_decides_outside_its_limits(spark):
    """With enough pairs learnt, only those between the limits have their words compared."""
    history = History(spark)
    assert history.limits() == (-np.inf, np.inf)
    history.counts = {(3, 3, 1, 1): [0, 900], (2, 3, 0, 1): [40, 60], (0, 0, 0, 0): [900, 0]}
    low, high = history.limits()
    weight = history.weights()
    score = {x: sum(weight[f, k] for f, k in zip(EVIDENCE, x)) for x in history.counts}
    assert score[0, 0, 0, 0] < low < score[2, 3, 0, 1] < high < score[3, 3, 1, 1]


def test_clusters_join(spark):
    """A record that repeats two accepted ones joins their clusters, over loads too; representatives are the least records."""
    rng = random.Random(9)
    base = _words(rng)

    def changed(*spots):
        words = list(base)
        for k in spots:
            words[k] = f"y{k}"
        return words

    left, right, middle = changed(*range(0, 12)), changed(*range(100, 112)), base
    rows = [page(seq, html(" ".join(w)), f"http://a.example/{seq}", batch=batch) for seq, w, batch in ((1, left, 1), (2, right, 1), (3, middle, 2), (4, _words(rng), 2), (5, changed(5, 105), 3))]
    history = History(spark)
    got = {r.duplicate_seq: r.accepted_seq for r in deduplicated(table(spark, rows), history).collect()}
    assert got == {3: 1, 5: 1}
    assert {r.record_seq: r.representative for r in history.representatives().collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


def test_empty(spark):
    assert deduplicated(table(spark, [])).count() == 0
    assert deduplicated(table(spark, odd_rows())).count() == 0
    assert not same_words(None, b"1234") and not same_words(b"", b"")


def test_long_text(spark):
    words = " ".join(f"w{k}" for k in range(60_000))
    rows = [page(1, "<body>\n" + words), page(2, "<body>\n" + words + " more", batch=2), page(3, "<body>\n" + words[: len(words) // 2], batch=2)]
    assert [(r.accepted_seq, r.duplicate_seq) for r in deduplicated(table(spark, rows)).collect()] == [(1, 2)]


def test_representatives(spark):
    own = spark.createDataFrame([(k, k) for k in range(1, 9)], "record_seq bigint, representative bigint")
    links = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (8, 5), (3, 8)], "a bigint, b bigint")
    got = {r.record_seq: r.representative for r in merged(own, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 1, 6: 6, 7: 7}
