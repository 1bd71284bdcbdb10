"""Rows that fail to parse."""

from __future__ import annotations

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.rows import INDEX_LINE, WARC_TYPES, checked, invalid_rows, valid_rows

GOOD = "id,response,http://a/,2020-01-01T00:00:00Z,text/html,12,sha1:A"


def _verdicts(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string")
    tested = checked(rows, "raw_line", INDEX_LINE)
    bad = {r.raw_id: list(r.reasons) for r in invalid_rows(tested, "raw_id").collect()}
    good = {r.raw_id: r for r in valid_rows(tested, INDEX_LINE, "raw_id").collect()}
    assert set(bad) | set(good) == set(range(len(lines))) and not set(bad) & set(good)
    return bad, good


def test_known_rows(spark):
    lines = [
        GOOD,
        GOOD + "\r",
        GOOD.replace("response", " response\t").replace(",12,", ", 12 ,"),
        GOOD.replace("response", '"response"').replace("http://a/", '"http://a/?x=""1"",\n2"'),
        GOOD.replace(",12,", ",,"),
        GOOD.replace(",12,", ",9223372036854775807,"),
        GOOD.replace(",12,", ",00000000000000000000000012,"),
        None,
        "",
        GOOD.replace("response", "Response"),
        GOOD.replace(",12,", ",-1,"),
        GOOD.replace(",12,", ",1e3,"),
        GOOD.replace(",12,", ",9223372036854775808,"),
        GOOD.replace(",12,", ",١٢,"),
        GOOD + ",more",
        GOOD.replace("id,", ""),
        GOOD.replace("http", '"http'),
        GOOD.replace("http://a/", '"http://a/"x'),
        GOOD.replace("http://a/", 'http://"a"/'),
        GOOD.replace("http://a/", "http://a\n/"),
        GOOD + "\x01",
        '"' * 40_001 + "," * 6,
        "x" * 300_000 + GOOD,
    ]
    bad, good = _verdicts(spark, lines)
    assert set(good) == {0, 1, 2, 3, 4, 5, 6, 22}
    assert good[3].warc_target_uri == 'http://a/?x="1",\n2' and good[4].content_length is None and good[6].content_length == 12
    assert good[2].warc_type == "response" and good[2].content_length == 12 and good[1].warc_payload_digest == "sha1:A"
    assert bad[16] == ["broken quoting"] and bad[14] == ["8 fields instead of 7"] and bad[9] == ["warc_type: unknown value"] and bad[10] == ["content_length: not a number"]


def test_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([], "raw_id bigint, raw_line string, reasons int, line string")
    assert valid_rows(checked(rows, "raw_line", INDEX_LINE), INDEX_LINE, "raw_id").count() == 0
    rows = spark.createDataFrame([(1, GOOD, "x", 5), (1, GOOD, "x", 5)], "raw_id bigint, raw_line string, line string, warc_type int")
    assert valid_rows(checked(rows, "raw_line", INDEX_LINE), INDEX_LINE, "raw_id").count() == 2


def _by_reader(line: str) -> bool:
    """The same decision by a strict reader."""
    line = line[:-1] if line.endswith("\r") else line
    if "\x01" in line:
        return False
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end = at + 1
            while end < len(line):
                if line[end] == '"':
                    if line[end + 1 : end + 2] == '"':
                        end += 2
                        continue
                    break
                end += 1
            if end >= len(line):
                return False
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end] or "\n" in line[at:end]:
                return False
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            break
        if line[at] != ",":
            return False
        at += 1
    if len(fields) != 7:
        return False
    n = fields[5].strip(" \t")
    return fields[1].strip(" \t") in WARC_TYPES and (n == "" or (n.isascii() and n.isdigit() and int(n) < 2**63))


_piece = st.sampled_from(['"', ",", '""', "a", " ", "\n", "response", "12", "\r", ",,", "x", '","'])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(_piece, max_size=14).map("".join), min_size=30, max_size=60))
def test_against_reader(spark, lines):
    lines = [*lines, *(f"a,response,{x},,,1,b" for x in lines if "\r" not in x)]
    bad, _ = _verdicts(spark, lines)
    assert set(bad) == {k for k, x in enumerate(lines) if not _by_reader(x)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='ab",\n ', max_size=6), st.sampled_from(WARC_TYPES), st.text(alphabet='ab",\n ', max_size=6), st.integers(0, 2**63 - 1)), min_size=1, max_size=30))
def test_written_rows_come_back(spark, rows):
    lines = []
    for a, kind, b, n in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow([a, kind, b, "", "", n, ""])
        lines.append(out.getvalue())
    bad, good = _verdicts(spark, lines)
    assert not bad and [(good[k].record_id, good[k].warc_type, good[k].warc_target_uri, good[k].content_length) for k in range(len(rows))] == rows
