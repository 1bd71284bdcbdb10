"""Spam pages, template residue and main content."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarry.llm.main_content import main_lines, main_texts, winning_paths
from quarry.llm.prose import N, events, train
from quarry.llm.residue import residue_pages
from quarry.llm.spam import spam_pages
from quarry.llm.structure import analyse, edges_of, form_of, skeleton
from tests.llm.helpers import NAMES, article, html, odd_rows, page, prose, table


def _stuffed(k: int) -> str:
    rng = random.Random(k)
    words = [rng.choice(["cheap", "buy", "shoes", "loan", "offer", "phone case", *NAMES]) for _ in range(120)]
    return html(f"<h1>{' '.join(words[:5])}</h1>", *(f"<p>{' '.join(words[j : j + 30])}</p>" for j in range(0, 120, 30)))


def _links(k: int) -> str:
    rng = random.Random(k)
    return html(*(f"<li><a href=/{j}>{rng.choice(NAMES)} price {rng.choice(NAMES)}</a></li>" for j in range(40)))


def _listed(k: int) -> str:
    """Links that each come with a sentence: no spam."""
    return html("<article>", *(f"<li><a href=/{j}>{NAMES[j]}</a> – {prose(k + j)}</li>" for j in range(12)), "</article>")


@pytest.fixture(scope="module")
def crawl(spark):
    rows, kinds = [], {}
    seq = 0

    def add(kind: str, text: str, uri: str = "http://big.example/", status: str = "200 OK") -> None:
        nonlocal seq
        seq += 1
        kinds[seq] = kind
        rows.append(page(seq, text, uri + str(seq), status=status))

    for k in range(60):
        add("article", article(k))
        add("article", article(k, ("fr", "de", "ru", "pl")[k % 4], "Birk Review", "div class=c1"), "http://other.example/")
    add("article", article(1, site="Cole Times"), "http://tiny.example/")
    for k in range(6):
        add("spam", _stuffed(k))
        add("spam", _links(k))
        add("listed", _listed(k * 13))
        add("error", html("<h1>Error 404</h1>", f"<p>The page /x/{k} could not be found on this server.</p>", f"<small>ref 12ab{k}</small>"), status="404 Not Found")
        add("error", html("<noscript><p>Please enable JavaScript to view this page.</p></noscript>"))
        add("filler", html("<p>Lorem ipsum dolor amet terra silva mensa.</p>", "<p>asdf jkl asdf qwer</p>"))
        add("gap", article(k + 70).replace("the report of", "the {{ author }} report of", 1))
    add("article", article(90).replace("the report of", "the <code>{{ author }}</code> report of"))
    add("article", article(91), status="404 Not Found")
    return table(spark, [*rows, *odd_rows()]), kinds


def test_events():
    """A run belongs to the function word or the end of the line that follows it; lines do not touch."""
    both = events(["", "The old Mill of Elm", "1900 keys"])
    assert both.words.tolist() == [0, 5, 2] and both.function.tolist() == [0, 2, 0] and both.sizes.tolist() == [1, 3, 1]
    alone = [events([x]).codes.tolist() for x in ("", "The old Mill of Elm", "1900 keys")]
    assert both.codes.tolist() == sum(alone, [])
    assert events([]).codes.size == 0 and events(["", ""]).words.tolist() == [0, 0]
    assert (events(["x " * 5000]).codes < N**3).all()


def test_prose_model():
    at, n = np.unique(np.concatenate([events([prose(k)]).codes for k in range(200)]), return_counts=True)
    model = train(at, n)
    assert np.isfinite(model.logs).all() and len(model.logs) == N**3
    new, words, tags = model.perplexities(events([prose(777), "buy Alder phone case Birk cheap Cole loan Dane shoes Elm deal", "casino chips Alder Birk"]))
    assert model.low < new < model.high < min(words, tags)
    empty = train(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert np.isfinite(empty.logs).all() and empty.low < empty.high


def test_skeletons():
    """Names, numbers, paths and addresses are slots; one after the other they are one."""
    a, b = skeleton("The page /x/1 could not be found, Alder Birk."), skeleton("The page http://a.example/b could not be found, Cole")
    assert a == b and form_of(a) == form_of(b) is not None
    assert form_of(skeleton("Alder 12 Birk")) is None and skeleton("") == [] and skeleton("— | —") == []
    assert set(edges_of(skeleton("please do turn on scripts to see Alder"))) & set(edges_of(skeleton("please do turn on whatever helps to see Birk")))


def test_spam(crawl):
    records, kinds = crawl
    got = {r.record_seq for r in spam_pages(records).collect()}
    assert got == {k for k, v in kinds.items() if v == "spam"}


def _wordy(k: int) -> list[str]:
    """Stuffing made of function words and keywords in the order of prose."""
    terms = [f"report of the {w}" for w in ("council", "engineer", "miller")]
    rng = random.Random(k)
    return [" ".join(f"and the {rng.choice(terms)}" for _ in range(12)).capitalize() + "." for _ in range(5)]


def test_stuffing_with_function_words(spark):
    """Word order and function words of prose: seen by repetition, in a container and beside."""
    rows = [page(k, article(k)) for k in range(60)]
    rows += [page(100 + k, html(*(f"<p>{x}</p>" for x in _wordy(k)))) for k in range(3)]
    rows += [page(200 + k, html("<div style='display:none'>", *(f"<p>{x}</p>" for x in _wordy(k)), "</div>")) for k in range(3)]
    rows += [page(300 + k, html(*(f"<p>{prose(k * 9 + j)}</p>" for j in range(4)))) for k in range(3)]
    rows += [page(400 + k, html("<article>", *(f"<p>{prose(k)}</p>" for _ in range(6)), "</article>")) for k in range(3)]
    got = {r.record_seq for r in spam_pages(table(spark, rows)).collect()}
    assert got == {100, 101, 102, 200, 201, 202}


def test_much_filler_in_a_container(spark):
    """Filler in a container is none the less so for being long: its lines are one template, so no article and no main body."""
    filler = [f"<p>This is the sample paragraph {k} about {NAMES[k]} and it will be replaced with the story of the editor.</p>" for k in range(6)]
    rows = [page(k, article(k)) for k in range(60)] + [page(100, html("<div>", *filler, "</div>"))]
    records = table(spark, rows)
    assert {r.record_seq: r.kind for r in residue_pages(records).collect()} == {100: "error"}
    assert 100 not in {r.record_seq for r in main_lines(records).collect()}


def test_default_text(spark):
    """Text of words that only pages without an article share; a page of its own words is none."""
    words = [a + b for a in "grav mens lor ips terr silv orb caus fin urn".split() for b in ("is", "um", "a")]
    rng = random.Random(5)
    rows = [page(k, article(k)) for k in range(60)]
    rows += [page(100 + k, html(*(f"<p>{' '.join(rng.choice(words) for _ in range(25)).capitalize()}.</p>" for _ in range(4)))) for k in range(5)]
    rows += [page(200 + k, html(*(f"<p>{' '.join(rng.choice([f'xyz{chr(97 + k)}{w}' for w in words]) for _ in range(20)).capitalize()}.</p>" for _ in range(4)))) for k in range(3)]
    assert {r.record_seq: r.kind for r in residue_pages(table(spark, rows)).collect()} == dict.fromkeys(range(100, 105), "filler")


def test_templates_whatever_the_status(spark):
    """A page in words of no list, sent as 200 again and again, is a template; furniture and a single short page are none."""
    rows = [page(k, article(k)) for k in range(60)]
    rows += [page(100 + k, html(f"<h1>Oh dear, Item {k}</h1>", f"<p>Unplugged shelf {k}: back soon.</p>")) for k in range(4)]
    rows += [page(200 + k, html("<footer>", "<p>© Alder Post. All rights reserved.</p>", "</footer>")) for k in range(4)]
    rows += [page(300, html("<p>One small greeting.</p>"))]
    rows += [page(400 + k, html(f"<p>Switch on whatever helps to see {t}</p>")) for k, t in enumerate(("an old mill", "the song of Elm", "Birk, deep water", "nothing"))]
    got = {r.record_seq: r.kind for r in residue_pages(table(spark, rows)).collect()}
    assert got == dict.fromkeys([*range(100, 104), *range(400, 404)], "error")


def test_copies_of_an_article_are_no_template(spark):
    """The same article again and again has nothing in its slots that differs."""
    rows = [page(k, article(3)) for k in range(8)] + [page(50 + k, article(k)) for k in range(40)]
    records = table(spark, rows)
    assert residue_pages(records).count() == 0 and len({r.record_seq for r in main_lines(records).collect()}) == 48


def test_residue(crawl):
    records, kinds = crawl
    got = {r.record_seq: r.kind for r in residue_pages(records).collect() if r.record_seq < 900}
    assert set(got) == {k for k, v in kinds.items() if v in ("error", "filler", "gap")}
    assert {kinds[k] for k, v in got.items() if v == "gap"} == {"gap"}


def test_main_content(crawl):
    records, kinds = crawl
    lines: dict[int, set[int]] = {}
    for r in main_lines(records).collect():
        lines.setdefault(r.record_seq, set()).add(r.line_no)
    assert set(lines) == {k for k, v in kinds.items() if v in ("article", "gap", "listed")}
    content = article(0).split("\n")
    body = {k for k, line in enumerate(content, 1) if line.startswith(("<h1>", "<p class=text>", "<h2>", "<li>Item"))}
    assert all(lines[k] == body for k, v in kinds.items() if v in ("article", "gap"))


def test_main_texts(crawl):
    records, kinds = crawl
    texts = {r.record_seq: r.text for r in main_texts(records).collect()}
    assert texts[1].startswith("Report 0 from") and "Follow" not in texts[1] and texts[1].endswith("Item, count: 12")


def test_votes(crawl):
    wins = {r.site: r.win for r in winning_paths(analyse(crawl[0], True)).collect()}
    assert wins["big.example"] == "article" and wins["other.example"] == "div.c0"


GAPS = "{{ author }} {{a.author}} {% block author %} ${author} #{author} {$author} <%= author %> %%AUTHOR%% @@author@@ $$author$$ __AUTHOR__ [[author]] [insert author here] [Your author] &lt;author goes here&gt;"


def test_gaps_by_alignment(spark):
    """Marks of many languages around names that come again; marks in one kind of text, quoted marks, and other names in the same marks are none."""
    marks = [(GAPS.replace("author", name)).replace("&lt;", "<").replace("&gt;", ">") for name in ("author", "city", "price", "date")]
    import re

    each = [re.findall(r"\{[%{].*?[%}]\}|<.*?>|\[+.*?\]+|\S+", m) for m in marks]
    rows, gap = [], set()
    for k, mark in enumerate(x for m in each for x in m):
        rows.append(page(k, article(k).replace("the report of", f"the {mark.replace('<', '&lt;').replace('>', '&gt;')} report of", 1)))
        gap.add(k)
    for k, text in enumerate(("a &lt; b &gt; c", "100 % of it", "[1] see below", "mail@host", "$5 and $6", "snake_case_name", "{a set}", "# heading", "[sic]", "&lt;unknown&gt;", "<code>{{ author }}</code>")):
        rows.append(page(500 + k, article(500 + k).replace("the report of", f"the {text} report of", 1)))
    got = {r.record_seq for r in residue_pages(table(spark, rows)).collect() if r.kind == "gap"}
    assert got == gap


def test_small_tables(spark):
    for rows in ([], odd_rows(), [page(1, "<body>\n" + "word " * 200_000)]):
        for operator in (spam_pages, residue_pages, main_lines):
            operator(table(spark, rows)).count()
    twice = table(spark, [page(1, _stuffed(1))] * 2)
    assert spam_pages(twice).count() == 2
