"""Small archive tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

H = "array<struct<name: string, value: string>>"
SCHEMA = f"record_seq bigint, batch_no int, rec_type string, rec_headers {H}, http_statusline string, http_headers {H}, payload binary, site string, key string, ctype int"


def headers(**values: str) -> list[dict[str, str]]:
    return [{"name": n.replace("_", "-"), "value": v} for n, v in values.items() if v is not None]


def page(seq: int, html: str | bytes, uri: str | None = "http://a.example/x", ctype: str | None = "text/html; charset=utf-8", status: str = "200 OK", batch: int = 1, kind: str = "response", **more: str):
    """A row with further columns whose names the operators use themselves."""
    body = html.encode() if isinstance(html, str) else html
    return (seq, batch, kind, headers(WARC_Target_URI=uri), status, headers(**({"Content_Type": ctype} | more)), bytearray(body), "extra", "extra", 7)


def table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def html(*lines: str, head: str = "") -> str:
    return "\n".join(["<html>", "<head>", head, "</head>", "<body>", *lines, "</body>", "</html>"])


def odd_rows() -> list:
    """Rows that must not matter or break anything."""
    return [
        (900, None, None, None, None, None, None, None, None, None),
        (901, 1, "response", None, None, None, bytearray(b""), None, None, None),
        (902, 1, "response", None, None, None, None, None, None, None),
        (903, 1, "request", [], "", [], bytearray(b"x"), None, None, None),
        page(904, b"\x89PNG", ctype="image/png"),
        page(905, b"\xff\xfe\x00<body", ctype="text/html; charset=nonsense", uri="not a uri"),
        page(906, "", uri=None),
        page(907, "<body>", uri="<http://WWW.b.example:80/>"),
        page(908, b"broken", Content_Encoding="gzip"),
        page(909, b"zz\r\nbroken", Transfer_Encoding="chunked"),
    ]


SENTENCES = {
    "en": "The {a} walked along the {b} bank and wrote down what the {c} had said about the flood of {n}. It was not the first time that the {d} of {w} had heard of it, and they decided to wait for the report of the engineer.",
    "fr": "Le {a} de {w} a décidé que le {b} serait réparé avant la fin de l’été, et les {c} ont été prévenus par le maire. Après la crue de {n}, il était resté fermé pendant des mois, malgré les {d} de la ville.",
    "de": "Der {a} von {w} hat beschlossen, dass die {b} bis zum Ende des Sommers über den Fluss wieder geöffnet wird. Nach dem Hochwasser von {n} war sie für die {c} und {d} nicht zu benutzen, größere Schäden blieben.",
    "ru": "Совет города {w} решил, что {a} будет открыт до конца лета, и {b} узнали об этом из газеты. После разлива {n} года он был закрыт на {c}, хотя {d} и купцы просили о другом решении.",
    "pl": "Rada miasta {w} uznała, że {a} będzie otwarty przed końcem lata, choć {b} żądali tego już wcześniej. Po {c} z {n} roku był on zamknięty przez całą zimę, a {d} nie mogli się z tym pogodzić.",
}
#: Words for any language, so that no two sentences have the same form.
NOUNS = [a + b for a in "tal mir sov dek pun rel gam lis nor bek".split() for b in "ar in om ut ek".split()]
NAMES = "Alder Birk Cole Dane Elm Fenn Gale Holt Ives Jarl Kerr Lund Moor Nash Orme Pell Quill Reed Stow Thorn".split()


def prose(k: int, lang: str = "en") -> str:
    rng = random.Random(f"{lang} {k}")
    return SENTENCES[lang].format(n=1800 + k % 200, w=NAMES[k % 20] + NAMES[(k // 20) % 20].lower(), **{x: rng.choice(NOUNS) for x in "abcd"})


def article(k: int, lang: str = "en", site: str = "Alder Post", tag: str = "article", paragraphs: int = 4) -> str:
    """A page with furniture around an article."""
    body = [f"<p class=text>{prose(k * 7 + j, lang)}</p>" for j in range(paragraphs)]
    return html(
        f"<p>{site} uses cookies to keep this site working.</p>", "<nav>", '<a href="/0">Home</a> <a href="/1">News</a>', "</nav>",
        f"<{tag}>", f"<h1>Report {k} from {NAMES[k % 20]}</h1>", f"<p>By {NAMES[k % 20]} Writer</p>", "<p>Updated 01.02.2020 10:11 (12)</p>", *body[:2],
        f"<p>Follow {site} on your favourite network.</p>", *body[2:], "<h2>Heading</h2>", "<li>Item, count: 12</li>", f"</{tag}>",
        "<footer>", f"<p>© {site}. All rights reserved.</p>", "</footer>",
    )
