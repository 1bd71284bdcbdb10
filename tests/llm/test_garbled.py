"""Garbled text."""

from __future__ import annotations

import pytest

from quarry.llm.encodings import LOST, PAIRS, STATES, garbled, restored
from quarry.llm.garbled import garbled_pages
from tests.llm.helpers import html, odd_rows, page, prose, table


@pytest.mark.parametrize("pair", PAIRS)
def test_pairs_undo_each_other(pair):
    text = {"cp1251": "привет", "koi8-r": "привет", "cp866": "привет", "iso8859-5": "привет", "cp1250": "źdźbło", "iso8859-2": "źdźbło"}.get(pair[0], "été à l’île" if pair[0] != "cp437" else "été")
    wrong = garbled(text, (pair,))
    assert wrong is not None and restored(wrong, (pair,)) == text


def test_states():
    assert len(set(STATES)) == len(STATES)
    twice = (("utf-8", "cp1252"), ("utf-8", "cp1252"))
    assert restored(garbled("é", twice), twice) == "é" and garbled("é", twice) == "ÃƒÂ©"
    assert restored("abc€", (("utf-8", "latin-1"),)) is None


@pytest.fixture(scope="module")
def corpus(spark):
    rows, wrong = [], {}
    seq = 0
    for lang in ("fr", "de", "ru", "pl", "en"):
        for k in range(60):
            seq += 1
            rows.append(page(seq, html(*(f"<p>{prose(k * 11 + j, lang)}</p>" for j in range(6)))))
    cases = [("fr", ("utf-8", "cp1252")), ("fr", ("utf-8", "latin-1")), ("de", ("utf-8", "mac-roman")), ("de", ("utf-8", "cp437")), ("ru", ("utf-8", "cp1251")), ("ru", ("koi8-r", "cp1251")), ("ru", ("cp1251", "latin-1")), ("pl", ("cp1250", "cp1252")), ("pl", ("utf-8", "cp1250"))]
    for k, (lang, pair) in enumerate(cases):
        for m in range(3):
            seq += 1
            clean = prose(k * 31 + m, lang)
            text = garbled(clean, (pair,))
            rows.append(page(seq, html("<p>before</p>", f"<p>{text}</p>", f"<p>{prose(m, lang)}</p>")))
            wrong[seq] = clean
    seq += 1
    rows.append(page(seq, html(f"<p>lost {LOST * 2} marks</p>")))
    wrong[seq] = None
    seq += 1
    rows.append(page(seq, html("<p>" + prose(3, "fr").encode().decode("latin-1").replace("\xa0", "&nbsp;") + "</p>"), ctype="text/html; charset=utf-8"))
    wrong[seq] = None
    for lang, own, said in (("fr", "cp1252", "utf-8"), ("ru", "cp1251", "utf-8"), ("pl", "cp1250", "utf-8"), ("ru", "utf-8", "cp1252")):
        seq += 1
        body = [prose(k * 3 + seq, lang) for k in range(3)]
        rows.append(page(seq, html(*(f"<p>{x}</p>" for x in body)).encode(own), ctype=f"text/html; charset={said}"))
        wrong[seq] = body[1]
    for text in ("<p>shown as <code>Ã©</code> here</p>", "<p>LÃ VÉGÉTÉ, PÃO E MAÇÃ</p>", "<p>&#233;t&#233;</p>", "<p>plain</p>", "<p>ТЕКСТ: ИВАН ПЕТРОВ</p>"):
        seq += 1
        rows.append(page(seq, html(text)))
    return table(spark, [*rows, *odd_rows()]), wrong


def test_found_and_restored(corpus):
    records, wrong = corpus
    got = {r.record_seq: r for r in garbled_pages(records).collect()}
    known = set(wrong) | {905}  # of the odd rows, one is no UTF-8
    assert set(got) <= known and len(set(got) & set(wrong)) >= 0.95 * len(wrong)
    right = sum(clean in got[k].restored for k, clean in wrong.items() if clean and k in got)
    assert right >= 0.7 * len(wrong)
    sent_wrongly = [k for k in wrong if any(s.state.split(" read as ")[0] in ("cp1252", "cp1251", "cp1250", "utf-8") and s.state.endswith(("read as utf-8", "read as cp1252")) and LOST in s.before for s in got[k].spans)]
    assert len(sent_wrongly) >= 4 and all(wrong[k] in got[k].restored for k in sent_wrongly)


def test_small_tables(spark):
    assert garbled_pages(table(spark, [])).count() == 0
    assert garbled_pages(table(spark, [page(1, "<body>\nplain")])).count() == 0
    long = page(1, "<body>\n<p>" + "Ж" * 300_000 + "</p>")
    assert garbled_pages(table(spark, [long, long])).count() in (0, 2)
