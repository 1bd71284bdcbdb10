"""What a page consists of: prose, keywords, lines that other pages have too, and the containers they stand in.

One pass over the pages writes a compact table (numbers and hashes, no text) that the operators for
main content, spam pages and template residue start from. It needs the prose model, which a first
pass counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import workspace
from quarry.llm.blocks import Line, lines_of, sentence_lines
from quarry.llm.encodings import LOST, STATES, letters, restored
from quarry.llm.pages import columns, contents, page_records
from quarry.llm.prose import Model, N, events, train

#: Fewest words of a line that can be prose.
LEAST_WORDS = 4
#: What another reading of a line must leave of its perplexity.
CLEARER = 0.5
#: Lines the model learns from: so many words, such a share of function words, a sentence mark at the end.
TAUGHT_WORDS, TAUGHT_SHARE = 10, 0.2
#: Prose words in one container that make an article.
ARTICLE = 30
#: Words of a piece in which repetition is looked for, and how often each pair of words may stand in it.
PIECE, OFTEN = 60, 2
#: Share of word pairs beyond that which makes stuffing of the text of a container, and of text outside of containers.
STUFFED, LOOSELY_STUFFED = 0.15, 0.08
#: Containers that never hold the main body, but for the header of an article.
ASIDE = re.compile(r"(?:^|/)(?:nav|aside|footer)(?=$|[/.#\[])|(?:^|/)(?<!article/)header(?=$|[/.#\[])")
_aside: dict[str, bool] = {}


def aside(path: str) -> bool:
    """ASIDE, remembered by path."""
    got = _aside.get(path)
    if got is None:
        got = bool(ASIDE.search(path))
        if len(_aside) < 50_000:
            _aside[path] = got
    return got


ENDS = re.compile(r"[.!?…]['\"”“»’)\]]*$")
HIGH = re.compile(r"[^\x00-\x7f]+")


def count_trigrams(pages: DataFrame) -> DataFrame:
    """code, n of the trigrams in sentence lines of all pages."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            found = events([x for content in contents(batch) for x in sentence_lines(content)])
            if len(found.codes):
                taught = np.repeat((found.words >= TAUGHT_WORDS) & (found.function >= TAUGHT_SHARE * found.words), found.sizes)
                at, n = np.unique(found.codes[taught], return_counts=True)
                total[at] += n
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return pages.mapInArrow(part, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def prose_model(pages: DataFrame) -> Broadcast:
    """The trained model; the fixed symbol set bounds what is collected and sent."""
    rows = count_trigrams(pages).collect()
    return pages.sparkSession.sparkContext.broadcast(train(np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.int64)))


_LETTERS = [(s, letters(s)) for s in STATES]
_memo: dict[tuple, dict[str, str | None]] = {s: {} for s in STATES}


def _undone(run: str, state: tuple, memo: dict[str, str | None]) -> str | None:
    """restored(), remembered: the words of spam come again and again."""
    if run in memo:
        return memo[run]
    new = restored(run, state)
    if len(memo) < 20_000:
        memo[run] = new
    return new


#: Lines whose other reading a worker remembers: those of the furniture come again on every page.
_read: dict[str, bool] = {}
_WIDE = [(s, may) for s, may in _LETTERS if s[0][0] == "utf-8" or len(s) > 1]


def reading(text: str, model: Model, odd: float) -> bool:
    """Whether a line of perplexity odd is prose once a wrong reading of its bytes is undone."""
    got = _read.get(text)
    if got is None:
        got = _reading(text, model, odd)
        if len(_read) < 50_000:
            _read[text] = got
    return got


def _reading(text: str, model: Model, odd: float) -> bool:
    runs = set(HIGH.findall(text))
    if len(runs) < 3:
        return False
    found = text.split()
    # one byte for one: function words of few letters outside ASCII can be read as they stand
    states = _LETTERS if 2 * sum(not w.isascii() for w in found) >= len(found) else _WIDE if max(map(len, runs)) > 1 else ()
    others: set[str] = set()
    for state, may in states:
        memo = _memo[state]
        if sum(may.issuperset(r) and _undone(r, state, memo) is not None for r in runs) >= max(3, len(runs) // 2):
            others.add(HIGH.sub(lambda m: _undone(m.group(0), state, memo) or m.group(0), text))
    if not others:
        return False
    now = model.perplexities(events(list(others)))
    return bool((model.normal(now) & (now <= CLEARER * odd)).any())


#: States whose inverse transform hardly any text passes that was not read wrongly.
_SURE = [(s, may) for s, may in _LETTERS if s[0][0] == "utf-8"]


def misread(text: str) -> bool:
    """Whether most of a line's runs outside ASCII are UTF-8 that was read as something else."""
    runs = HIGH.findall(text)
    return len(runs) >= 3 and max(map(len, runs)) > 1 and any(sum(may.issuperset(r) and _undone(r, state, _memo[state]) is not None for r in runs) >= 0.7 * len(runs) for state, may in _SURE)


def repetition(texts: list[str], least: float = 0.0) -> float:
    """Share of word pairs that come more than OFTEN times in their piece; 0 if it can't reach least. A line that comes again counts once."""
    found: list[str] = []
    for text in dict.fromkeys(texts):
        found += text.lower().split()
    every = list(zip(found, found[1:]))
    if len(every) - len(set(every)) < least * (len(every) - len(every) // PIECE - PIECE // 5):
        return 0.0
    pairs = again = 0
    for k in range(0, len(found), PIECE):
        both = every[k : k + PIECE - 1]
        n = len(both)
        if n < PIECE // 5:
            continue
        pairs += n
        if n - len(set(both)) >= OFTEN:
            again += sum(c - OFTEN for c in Counter(both).values() if c > OFTEN)
    return again / pairs if pairs else 0.0


def digest(text: str) -> int:
    """64-bit key of a text."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


#: A slot: a name, a number, a path, an address.
SLOT = "\0"
_INNER = re.compile(r"[^\W\d_][/.:@_#][^\W\d_]|[/\\@#_]")
_EDGES = "\"'“”„«»‘’()[]<>¿¡.,;:!?–—-|…"


class _Masked(dict):
    """word -> the word in lower case without marks, SLOT, or nothing for a mere mark; new words are kept up to a bound."""

    def __missing__(self, word: str) -> str:
        bare = word.strip(_EDGES)
        if not any(map(str.isalnum, bare)):
            got = ""
        elif bare[0].isupper() or any(c.isdigit() for c in bare) or _INNER.search(bare):
            got = SLOT
        else:
            got = bare.lower()
        if len(self) < 400_000:
            self[word] = got
        return got


_masked = _Masked().__getitem__
#: Words at either end of a line that are aligned with the ends of others.
EDGE = 4


def skeleton(text: str) -> list[str]:
    """A line's words; names, numbers and paths in a row are one slot. A line in capitals has no names."""
    out = list(filter(None, map(_masked, (text.lower() if text.isupper() else text).split())))
    if out.count(SLOT) > 1:
        return [w for w, before in zip(out, ["", *out]) if w != SLOT or before != SLOT]
    return out


def form_of(words: list[str]) -> int | None:
    """Key of a skeleton with words of its own."""
    return digest(" ".join(words)) if len(words) > 1 or words and words[0] != SLOT else None


def edges_of(words: list[str]) -> list[int]:
    """Keys of both ends of a longer skeleton: what stands before or after a slot that holds anything."""
    if len(words) <= EDGE:
        return []
    return [digest(mark + " ".join(part)) for mark, part in ((">", words[:EDGE]), ("<", words[-EDGE:])) if part.count(SLOT) <= EDGE - 2]


def pages_of(contents_: Iterator[str], model: Model) -> Iterator["Page"]:
    """Pages of a batch; their lines are scored together."""
    all_lines = [lines_of(content) for content in contents_]
    own = [[k for k, x in enumerate(lines) if not x.link] for lines in all_lines]
    found = events([lines[k].bare for lines, at in zip(all_lines, own) for k in at])
    odd = model.perplexities(found)
    fluent = ((found.words >= LEAST_WORDS) & model.normal(odd)).tolist()
    odd, words = odd.tolist(), found.words.tolist()
    start = 0
    for lines, at in zip(all_lines, own):
        end = start + len(at)
        yield Page(lines, at, words[start:end], fluent[start:end], odd[start:end], model)
        start = end


class Page:
    """Counts and lines of one page."""

    __slots__ = ("lines", "words", "prose", "keywords", "article", "loose", "total", "damaged", "is_prose", "fluent", "best", "stuffed")

    def __init__(self, lines: list[Line], own: list[int], words: list[int], fluent: list[bool], odd: list[float], model: Model) -> None:
        """words, fluent and odd (perplexity) are those of the lines in own, which are outside of links."""
        self.lines = lines
        n = [len(x.bare.split()) if x.link and LOST not in x.bare else 0 for x in lines]
        self.fluent = [False] * len(n)
        is_prose = [False] * len(n)
        self.stuffed = False
        lost = []
        for k, nw, a, p in zip(own, words, fluent, odd):
            x = lines[k]
            n[k] = nw
            self.fluent[k] = a
            if a:
                is_prose[k] = not x.noscript
            elif nw >= 6 and not x.bare.isascii():
                is_prose[k] = reading(x.bare, model, p)
                if not is_prose[k] and misread(x.bare):
                    lost.append(k)
        self.words = list(n)
        for k in lost:
            n[k] = 0
        self._count(n, is_prose)
        self.damaged += sum(self.words[k] for k in lost)

    def perplexity(self, model: Model) -> float:
        """Of all lines together."""
        found = events([x.bare for x in self.lines])
        return float(np.exp(-model.logs[found.codes].mean())) if len(found.codes) else 1.0

    def _count(self, n: list[int], is_prose: list[bool]) -> None:
        boxes: dict[int, int] = {}
        self.prose = self.keywords = self.loose = self.total = self.damaged = 0
        for x, nw, prose in zip(self.lines, n, is_prose):
            self.total += nw
            if LOST in x.bare and x.bare.count(LOST) > 0.02 * len(x.bare):
                self.damaged += max(nw, 1)
            elif prose:
                self.prose += nw
                if not x.path:
                    self.loose += nw
                elif not aside(x.path):
                    boxes[x.box] = boxes.get(x.box, 0) + nw
            else:
                self.keywords += nw
        self.best = max(boxes, key=boxes.get, default=0)
        while boxes.get(self.best, 0) >= ARTICLE and self._is_stuffed(is_prose, self.best, STUFFED):
            self._drop(n, is_prose, self.best)
            del boxes[self.best]
            self.best = max(boxes, key=boxes.get, default=0)
        self.article = boxes.get(self.best, 0)
        ended = any(prose and not x.path and ENDS.search(x.bare) for x, prose in zip(self.lines, is_prose)) if self.article < ARTICLE <= self.loose else True
        if self.article < ARTICLE <= self.loose and self._is_stuffed(is_prose, 0, LOOSELY_STUFFED):
            self._drop(n, is_prose, 0)
            self.loose = 0
        elif not ended:
            self.loose = 0
        self.is_prose = is_prose

    def _is_stuffed(self, is_prose: list[bool], box: int, most: float) -> bool:
        return repetition([x.bare for x, prose in zip(self.lines, is_prose) if prose and x.box == box], most) >= most

    def _drop(self, n: list[int], is_prose: list[bool], box: int) -> None:
        """The prose of a container becomes keywords."""
        self.stuffed = True
        for k, x in enumerate(self.lines):
            if is_prose[k] and x.box == box:
                is_prose[k] = False
                self.prose -= n[k]
                self.keywords += n[k]

    @property
    def in_box(self) -> bool:
        return self.article >= ARTICLE

    @property
    def beside(self) -> bool:
        """Whether the article stands in the body itself, on a page that has none in a container."""
        return not self.in_box and self.loose >= max(3 * ARTICLE, self.keywords)

    @property
    def has_article(self) -> bool:
        """Prose enough in one container, or beside containers on pages without such; damaged text counts as such, repetition does not."""
        return self.in_box or self.damaged >= ARTICLE or self.beside


#: Elements that belong to the body of an article whatever they say.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote figcaption caption pre table".split())
#: Longer lines are no notices of the site.
NOTICE_WORDS = 25
_DATE_LIKE = re.compile(r"\d{4}-\d\d-\d\d|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{1,2}:\d\d\b")
#: Path of an article that stands in the body itself.
BODY_ITSELF = "body"


def body_lines(page: Page, n: list[int], known: dict[int, int | None]) -> list[tuple[int, str, int | None, int | None]]:
    """(line_no, path, key, template) of lines that may belong to a main body; ``known`` has keys of skeletons by number of the line.

    Key and template are null for lines that need no comparison with the other pages of the site:
    a paragraph that ends like a sentence may still be one of the site's notices.
    """
    out = []
    beside = page.beside
    for x, nw in zip(page.lines, n):
        if not (x.path or beside) or x.link or x.noscript or aside(x.path):
            continue
        path = x.path or BODY_ITSELF
        if x.tag in PARTS:
            out.append((x.no, path, None, None))
        elif nw >= 3 and (nw >= 12 or ENDS.search(x.text) or LOST in x.text) and not (nw < 12 and _DATE_LIKE.search(x.text)):
            if nw > NOTICE_WORDS:
                out.append((x.no, path, None, None))
            else:
                form = known[x.no] if x.no in known else form_of(skeleton(x.bare))
                out.append((x.no, path, digest(x.text.lower()), 0 if form is None else form))
    return out


#: A variable's name.
_IDENTIFIER = r"[^\W\d_][^\W_]*(?:[_.-][^\W_]+)*"
#: A few words between marks that prose does not use: what a template language, or an editor, puts around a slot.
MARKED = re.compile(rf"([{{}}\[\]<>%$#@_^]+=?)\s*({_IDENTIFIER}(?:\s+{_IDENTIFIER})*)\s*([{{}}\[\]<>%$#@_^]+)")
_MARK = re.compile(r"[{}\[\]<>%$#@_^]")
#: So many characters of marks around a single name make it a variable by its looks.
SURE_MARKS = 3


def variables(text: str) -> list[tuple[str, str, bool]]:
    """(marks with a gap where a name may stand, that name, whether it is a variable by its looks) of a line.

    Several words between marks give one entry for each of them: where the name stands shows only
    when many records are aligned.
    """
    out = []
    for open_, inside, close in MARKED.findall(text):
        found = inside.lower().split()
        for k, word in enumerate(found):
            wrap = " ".join([open_, *found[:k], "\0", *found[k + 1 :], close])
            out.append((wrap, word.rpartition(".")[2], len(found) == 1 and len(open_) + len(close) >= SURE_MARKS))
    return out


_LINE = pa.struct([("no", pa.int32()), ("path", pa.string()), ("key", pa.int64()), ("template", pa.int64())])
_FORM = pa.struct([("form", pa.int64()), ("key", pa.int64()), ("words", pa.int32()), ("fluent", pa.int32())])
_USE = pa.struct([("word", pa.int64()), ("n", pa.int32()), ("small", pa.bool_())])
_VARIABLE = pa.struct([("wrap", pa.string()), ("name", pa.string()), ("sure", pa.bool_())])
ANALYSIS = pa.schema(
    [
        ("page", pa.int64()),
        ("record_seq", pa.int64()),
        ("site", pa.string()),
        ("status", pa.int32()),
        ("has_article", pa.bool_()),
        ("damaged", pa.bool_()),
        ("article", pa.int32()),
        ("total", pa.int32()),
        ("keywords", pa.int32()),
        ("perplexity", pa.float64()),
        ("normal", pa.bool_()),
        ("path", pa.string()),
        ("lines", pa.list_(_LINE)),
        ("forms", pa.list_(_FORM)),
        ("edges", pa.list_(pa.int64())),
        ("uses", pa.list_(_USE)),
        ("variables", pa.list_(_VARIABLE)),
    ]
)
ANALYSIS_DDL = (
    "page bigint, record_seq bigint, site string, status int, has_article boolean, damaged boolean, article int, total int, keywords int, perplexity double, normal boolean, "
    "path string, lines array<struct<no: int, path: string, key: bigint, template: bigint>>, forms array<struct<form: bigint, key: bigint, words: int, fluent: int>>, "
    "edges array<bigint>, uses array<struct<word: bigint, n: int, small: boolean>>, variables array<struct<wrap: string, name: string, sure: boolean>>"
)
#: Words of articles that a worker remembers to have sent.
REMEMBERED = 1_000_000


def _uses(page: Page) -> list[dict]:
    """Words of a page without an article: key, count, whether it stands there in lower case."""
    found: Counter = Counter()
    small: set[str] = set()
    for x in page.lines:
        for w in x.bare.split():
            word = _masked(w)
            if word == SLOT:
                if any(c.isdigit() for c in w):
                    continue
                word = w.strip(_EDGES).lower()
            elif word:
                small.add(word)
            else:
                continue
            found[word] += 1
    return [{"word": digest(w), "n": n, "small": w in small} for w, n in found.items()]


def analyse(records: DataFrame, with_lines: bool = False, with_residue: bool = True) -> DataFrame:
    """One row of counts for each page, written to the shared folder.

    ``page`` numbers the rows, as a record may come twice. ``forms`` has the lines outside of links: the key of their skeleton, that of their text, the
    words of prose they give to the article, and those of normal perplexity; ``normal`` is whether the
    perplexity of a page without an article is that of prose and its text does not foretell itself by
    repetition; ``edges`` the ends of the skeletons, and ``uses`` the words
    (of a page with an article only those in lower case outside of links that its worker has not sent before). ``variables`` is
    what stands between marks. Without ``with_residue`` edges, uses and variables are empty, and forms
    has only lines that may be prose.
    ``with_lines`` adds the lines that may be main body.
    """
    pages = page_records(records, F.expr("try_cast(split_part(http_statusline, ' ', 1) AS int) AS status"))
    model = prose_model(pages)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        sent: set[str] = set()
        n_pages = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for (seq, site, status), page in zip(columns(batch, "record_seq", "site", "status"), pages_of(contents(batch), m)):
                article, beside = page.has_article, page.beside
                odd = page.perplexity(m) if with_residue and not article else None
                best = BODY_ITSELF if beside else next((x.path for x in page.lines if x.box == page.best and x.path), None) if page.article else None
                n_pages += 1
                row = {"page": n_pages, "record_seq": seq, "site": site, "status": status, "has_article": article, "damaged": page.damaged >= ARTICLE, "article": page.loose if beside else page.article}
                row |= {"total": page.total, "keywords": page.keywords, "perplexity": odd, "normal": odd is None or (not page.stuffed and m.low <= odd <= m.high), "path": best, "lines": None, "variables": None}
                of = 0 if beside else page.best
                forms: list[dict] = []
                edges: set[int] = set()
                small: set[str] = set()
                known: dict[int, int | None] = {}
                for x, nw, prose, fluent in zip(page.lines, page.words, page.is_prose, page.fluent):
                    if x.link or not (with_residue or fluent or prose):
                        continue
                    skeleton_ = skeleton(x.bare)
                    if with_residue:
                        small.update(skeleton_)
                    known[x.no] = form = form_of(skeleton_)
                    if form is not None:
                        forms.append({"form": form, "key": digest(x.bare), "words": nw if prose and x.box == of else 0, "fluent": nw if fluent else 0})
                        if with_residue:
                            edges.update(edges_of(skeleton_))
                row["forms"], row["edges"], row["uses"] = forms, list(edges), []
                if with_lines and article:
                    row["lines"] = [dict(zip(("no", "path", "key", "template"), x)) for x in body_lines(page, page.words, known)]
                if article and with_residue:
                    small -= sent
                    if len(sent) < REMEMBERED:
                        sent |= small
                    row["uses"] = [{"word": digest(w), "n": 1, "small": True} for w in small]
                elif with_residue:
                    row["uses"] = _uses(page)
                if with_residue:
                    row["variables"] = [dict(zip(("wrap", "name", "sure"), v)) for x in page.lines if _MARK.search(x.bare) for v in variables(x.bare)]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, ANALYSIS)

    return workspace.written(pages.mapInArrow(part, ANALYSIS_DDL), "pages")
