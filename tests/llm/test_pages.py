"""Pages, lines and blocks."""

from __future__ import annotations

import gzip

from quarry.llm.blocks import lines_of
from quarry.llm.pages import page_records, page_text, text_lines
from tests.llm.helpers import odd_rows, page, table


def test_charsets():
    assert page_text("é".encode("latin-1"), "text/html; Charset='ISO-8859-1'", None, None) == "é"
    assert page_text(b'<meta charset="windows-1251">' + "ж".encode("cp1251"), "text/html", None, None).endswith("ж")
    assert page_text(b'<meta http-equiv="Content-Type" content="text/html; charset=koi8-r">' + "ж".encode("koi8-r"), None, None, None).endswith("ж")
    assert page_text("é".encode(), None, None, None) == "é" and page_text(b"\xe9", None, None, None) == "�"
    assert page_text(gzip.compress("é".encode()), "text/html", None, "gzip") == "é"
    assert page_text(b"1\r\nx\r\n0\r\n\r\n", None, "chunked", None) == "x"
    assert page_text(b"a", "text/html; charset=hex", None, None) == "a"


def test_lines():
    text = "<html>\n<title>no</title>\n<body class=x> not this\n<p>a&nbsp;&amp; b</p>\r\n\n<script>x\ny</script> z\n<noscript>n</noscript>\n<b>q</b>r <i\n1 < 2 > 3"
    assert text_lines(text) == [(4, "a & b"), (7, "z"), (8, "n"), (9, "q r <i"), (10, "1 < 2 > 3")]
    assert text_lines("no body\n<p>x") == [(1, "no body"), (2, "x")]
    assert text_lines("") == [] and text_lines("<body>") == [] and text_lines("<body><script>never ends\nx") == []
    assert [(x.no, x.text) for x in lines_of(text)] == text_lines(text)


def test_blocks():
    rows = lines_of('<body>\n<div class="m12">\n<li><a href=x>link</a></li>\n<p>say <code>{{x}}</code></p>\n</div></div>\n<noscript><p>on</p></noscript>\nplain')
    assert [(x.path, x.tag, x.link, x.noscript) for x in rows] == [("div.m0", "li", True, False), ("div.m0", "p", False, False), ("", "noscript", False, True), ("", "", False, False)]
    assert rows[1].bare == "say"


def test_page_records(spark):
    rows = [page(1, "x", "http://www.A.example:8080/p"), page(2, "x", "<https://a.example>"), page(3, "x", None), page(4, "x", ctype=None), page(5, "x", ctype="TEXT/HTML"), *odd_rows()]
    got = {r.record_seq: r.site for r in page_records(table(spark, rows)).collect()}
    assert got == {1: "a.example", 2: "a.example", 3: None, 4: "a.example", 5: "a.example", 905: None, 907: "b.example", 908: "a.example", 909: "a.example"}
    assert page_records(table(spark, [])).count() == 0


def test_plan_reads_only_what_is_needed(spark, tmp_path):
    table(spark, [page(1, "x")]).write.parquet(str(tmp_path / "t"))
    plan = page_records(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rec_type,response)" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "http_statusline" not in schema and "batch_no" not in schema and "Exchange" not in plan and "Python" not in plan
