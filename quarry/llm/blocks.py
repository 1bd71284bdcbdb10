"""Lines of a page with the container each stands in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from quarry.llm.pages import CODE, TAG, raw_lines

OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>")
CONTAINERS = frozenset("div section article main td th tr table tbody aside nav header footer center ul ol form dl fieldset".split())
_ATTRIBUTE = re.compile(r"""\b(id|class)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: 2 for containers, 1 for noscript, 0 for other elements, by name as it was met.
_KINDS: dict[str, int] = {}
_WS = re.compile(r"\s+")
_LINK = re.compile(r"\A(?:<[^aA/][^<>]*>\s*)*<a\b[^<>]*>.*</a\s*>(?:\s*</[^<>]*>)*\s*\Z", re.I | re.S)
_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.I | re.S)


class Line(NamedTuple):
    no: int
    text: str
    #: text without what code elements quote
    bare: str
    #: generalised path of the innermost container open at the start of the line, "" for the body itself
    path: str
    #: number of that container on the page
    box: int
    #: first element of the line
    tag: str
    #: all of its text is inside links
    link: bool
    noscript: bool


def general(tag: str, attributes: str) -> str:
    """tag.class or tag#id with digits set aside; other attributes count by their text when there is neither."""
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).strip().lower().split()
        if value:
            return tag + (".#"[kind.lower() == "id"]) + re.sub(r"\d+", "0", value[0])
    rest = _WS.sub(" ", attributes.strip().lower())
    return f"{tag}[{re.sub(r'[0-9]+', '0', rest)}]" if rest and tag in ("td", "th", "table", "div") else tag


#: Whether markup around links has no text, by that markup.
_bare: dict[str, bool] = {}


def _has_no_text(markup: str) -> bool:
    got = _bare.get(markup)
    if got is None:
        got = not TAG.sub("", markup).strip(" \t\r|›»·,")
        if len(_bare) < 10_000:
            _bare[markup] = got
    return got


def _all_links(raw: str) -> bool:
    """Whether a line with a link has no text outside of links."""
    if raw.count("<a ") == 1 and raw.count("</a>") == 1 and "<A" not in raw:
        return _has_no_text(raw[: raw.index("<a ")]) and _has_no_text(raw[raw.index("</a>") + 4 :])
    return _has_no_text(_ANCHOR.sub("", raw))


def lines_of(content: str) -> list[Line]:
    """Lines with text. Elements may end out of order or never; an end tag closes up to its last start tag."""
    out: list[Line] = []
    stack: list[tuple[str, str, int]] = []
    boxes = 0
    for no, raw in raw_lines(content):
        if "<" not in raw:
            text = " ".join(html.unescape(raw).split() if "&" in raw else raw.split())
            if text:
                out.append(Line(no, text, text, stack[-1][1] if stack else "", stack[-1][2] if stack else 0, "", False, False))
            continue
        path, box = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
        tag = ""
        noscript = False
        for closing, name, attributes in OPEN.findall(raw):
            kind = _KINDS.get(name)
            if kind is None:
                name = name.lower()
                kind = 2 if name in CONTAINERS else 1 if name == "noscript" else 0
                if len(_KINDS) < 1000:
                    _KINDS[name] = kind
            if not tag and not closing:
                tag = name.lower()
            if kind < 2:
                noscript |= kind == 1
                continue
            name = name.lower()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not attributes.endswith("/"):
                boxes += 1
                up = stack[-1][1] + "/" if stack else ""
                stack.append((name, up + general(name, attributes), boxes))
        shown = TAG.sub(" ", raw)
        text = " ".join((html.unescape(shown) if "&" in shown else shown).split())
        if not text:
            continue
        bare = text
        if "<code" in raw or "<CODE" in raw:
            bare = " ".join(html.unescape(TAG.sub(" ", CODE.sub(" ", raw))).split())
        link = ("<a " in raw or "<A " in raw) and _all_links(raw)
        out.append(Line(no, text, bare, path, box, tag, link, noscript))
    return out


#: A mark that ends a sentence, or a tag that closes, before the end of a line.
_LATE = re.compile(r"[.!?…]['\"”“»’)\]]*(?:\s|</?[A-Za-z][^<>]*>)*$")


def sentence_lines(content: str, least: int = 40) -> list[str]:
    """Lines outside of links, longer than so many characters, that end like a sentence."""
    out = []
    for _, raw in raw_lines(content):
        if len(raw) > least and _LATE.search(raw) and "<a " not in raw and "<A " not in raw:
            if "<code" in raw or "<CODE" in raw:
                raw = CODE.sub(" ", raw)
            if "<" in raw:
                raw = TAG.sub(" ", raw)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if len(text) > least:
                out.append(text)
    return out
