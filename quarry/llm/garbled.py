"""Garbled text from wrong character encodings.

A hidden Markov model labels the characters of a page: one clean state, one state per encoding
pair, and one for replacement marks. The observation of a character depends on the one before it.
The clean state's bigrams are counted over all pages; those of a pair's state are the clean ones
sent through the pair's wrong reading. As pages are not labelled, the table of all bigrams is a
mixture, and expectation maximisation takes what the pairs explain out of the clean state. Each
labelled span then gets its state's inverse transform.

Replacement marks that the declared charset leaves because the bytes are of another one are undone
from the bytes: the lines that can't be read are read as UTF-8 if they are, else in the encoding of
the pairs in which they read best under the clean state.

ASCII letters look the same in all states, so only their class is kept: the alphabet is that of
the pairs' encodings plus a few classes, and the collected table is bounded by its square.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.encodings import DEPTH, GONE, LOST, PAIRS, STATES, garbled, name, restored
from quarry.llm.pages import CODE, TAG, columns, contents, page_bytes, page_records, read_as

#: A run of other characters than ASCII, with the ASCII character on each side.
RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
OTHER = "\x7f"
ENTER, LEAVE = math.log(1e-3), math.log(0.02)
#: Probability of a bigram that a state has never seen, and of one the clean state has never seen.
UNSEEN, RARE = 1e-6, 5e-5
ROUNDS = 12
#: Runs looked at in one piece, so that memory does not grow with the page.
PIECE = 500
#: By how much (in nats) a restored span must read better than the span itself, case set aside.
SURER = 6.0
#: Bigrams with a smaller share of all are rare.
COMMON = 1e-4
#: Share of a restored span's bigrams that may be rare ones.
ODD = 0.25
#: How much of each pair is assumed before the first round.
SHARE = 0.002


def _alphabet() -> frozenset[str]:
    known = set()
    for name in {n for pair in PAIRS for n in pair} - {"utf-8"}:
        for b in range(128, 256):
            known.add(bytes([b]).decode(name, "ignore"))
            known.add(chr(b))
    return frozenset(known - {""}) | {LOST}


_KNOWN = _alphabet()


def shape(c: str) -> str:
    """A character as the model sees it."""
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
    return c if c in _KNOWN else OTHER


def shapes(run: str) -> str:
    return "".join(map(shape, run))


def fold(run: str) -> str:
    """Shapes in lower case."""
    return run.replace("A", "a").lower()


def plain(content: str) -> str:
    """Content without code elements and tags, character references resolved."""
    if "<code" in content or "<CODE" in content:
        content = CODE.sub(" ", content)
    content = TAG.sub("", content)
    if "&" in content:
        content = html.unescape(content)
    return content


def bigrams(text: str) -> Counter:
    """Counts of bigrams with at least one character outside ASCII."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        s = shapes(run)
        for k in range(len(s) - 1):
            out[s[k : k + 2]] += n
    return out


def count_bigrams(pages: DataFrame) -> DataFrame:
    """bigram, n over all pages."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in contents(batch):
                if not text.isascii() or "&" in text:
                    total.update(bigrams(plain(text)))
        yield pa.RecordBatch.from_pydict({"bigram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return pages.mapInArrow(part, "bigram string, n bigint").groupBy("bigram").sum("n").withColumnRenamed("sum(n)", "n")


class Model:
    """Log-likelihood ratios of each pair's state against the clean state, by bigram."""

    def __init__(self, counts: dict[str, int]) -> None:
        counts = {b: n for b, n in counts.items() if len(b) == 2}
        seen = list(counts)
        n = np.array([counts[b] for b in seen], float)
        total = max(n.sum(), 1.0)
        sent = [self._sent(state) for state in STATES]
        clean = n.copy()
        never = [any(c == LOST or "\x80" <= c < "\xa0" for c in b) for b in seen]  # controls are no text
        clean[never] = 0
        shares = np.full(len(STATES), SHARE)
        where = {b: k for k, b in enumerate(seen)}
        for _ in range(ROUNDS):
            joint = np.zeros((len(STATES), len(seen)))
            table = {b: c for b, c in zip(seen, clean) if c > 0.5}
            for s, send in enumerate(sent):
                for b, c in self._push(table, send).items():
                    k = where.get(b)
                    if k is not None:
                        joint[s, k] += c
            joint /= np.maximum(joint.sum(1, keepdims=True), 1e-9)
            weighted = shares[:, None] * joint
            of_clean = (1 - shares.sum()) * clean / max(clean.sum(), 1e-9)
            all_ = weighted.sum(0) + of_clean
            with np.errstate(invalid="ignore", divide="ignore"):
                part = np.nan_to_num(weighted / all_)
            clean = n * np.clip(1 - part.sum(0), 0, 1)
            clean[never] = 0
            shares = np.clip((part * n).sum(1) / total, 1e-6, 0.05)
        table = {b: c for b, c in zip(seen, clean) if c > 0.5}
        base = self._conditional(table, RARE)
        self.ratio: dict[str, np.ndarray] = {}
        own = [self._conditional(self._push(table, send), UNSEEN) for send in sent]
        self.base, self.own = base, own
        folded: defaultdict[str, float] = defaultdict(float)
        for b, n in table.items():
            folded[fold(b)] += n
        self.folded = self._conditional(folded, RARE)
        self.common = {b for b, n in folded.items() if n > COMMON * total}

    @staticmethod
    def _folded(text: str) -> list[str]:
        return [s[k : k + 2] for run in RUN.findall(text) for s in (fold(shapes(run)),) for k in range(len(s) - 1)]

    def fluency(self, text: str) -> float:
        """Log-likelihood of a text in the clean state, in lower case."""
        floor = self.folded[""]
        return sum(self.folded.get(b, floor) for b in self._folded(text))

    def better(self, new: str, old: str) -> bool:
        """Whether a restored text reads better than what it comes from."""
        now = self._folded(new)
        if sum(b not in self.common for b in now) > ODD * len(now):
            return False
        return self.fluency(new) > self.fluency(old) + SURER

    @staticmethod
    def _sent(state: tuple[tuple[str, str], ...]) -> dict[str, str]:
        """What each known character becomes; absent where it can't be written or does not change."""
        out = {}
        for c in _KNOWN:
            g = garbled(c, state)
            if g is not None and g != c:
                out[c] = shapes(g)
        return out

    @staticmethod
    def _push(table: dict[str, float], send: dict[str, str]) -> dict[str, float]:
        """Bigram counts of the text after a wrong reading."""
        out: defaultdict[str, float] = defaultdict(float)
        for (a, b), n in table.items():
            ga = a if a < "\x80" else send.get(a)
            gb = b if b < "\x80" else send.get(b)
            if ga is None or gb is None:
                continue
            out[ga[-1] + gb[0]] += n
            for k in range(len(gb) - 1):
                out[gb[k : k + 2]] += n
        return out

    @staticmethod
    def _conditional(table: dict[str, float], floor: float) -> dict:
        """log P(second | first) of the seen bigrams; under "" the log of the floor."""
        first: defaultdict[str, float] = defaultdict(float)
        for b, n in table.items():
            first[b[0]] += n
        return {b: math.log(n / (first[b[0]] + 5.0) + floor) for b, n in table.items()} | {"": math.log(floor)}

    def ratios(self, bigram: str) -> np.ndarray:
        """Ratio of each pair's state; zero where nothing tells them from the clean state."""
        got = self.ratio.get(bigram)
        if got is None:
            if bigram[0] < "\x80" and bigram[1] < "\x80":
                got = np.zeros(len(STATES))
            else:
                low = self.base.get(bigram, self.base[""])
                got = np.array([own.get(bigram, own[""]) for own in self.own]) - low
            self.ratio[bigram] = got
        return got

    def may_be_garbled(self, text: str) -> bool:
        """Whether some path that leaves the clean state beats it; exact, as pair states only meet in the clean one."""
        if LOST in text:
            return True
        runs = RUN.findall(text)
        if not runs:
            return False
        sum_, low = np.zeros(len(STATES)), np.zeros(len(STATES))
        for at in range(0, len(runs), PIECE):
            steps = [self.ratios(s[k : k + 2]) for s in map(shapes, runs[at : at + PIECE]) for k in range(len(s) - 1)]
            a = np.cumsum(np.array(steps), axis=0) + sum_
            lows = np.minimum(np.minimum.accumulate(np.vstack([low, a[:-1]]), axis=0), low)
            if ((a - lows).max(0) + ENTER + LEAVE > 0).any():
                return True
            sum_, low = a[-1], np.minimum(lows[-1], a[-1])
        return False

    def label(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the spans outside the clean state; state len(STATES) marks lost characters."""
        spots: list[tuple[int, int]] = []
        steps: list[np.ndarray] = []
        for m in RUN.finditer(text):
            run = m.group(0)
            s = shapes(run)
            for k in range(len(s) - 1):
                steps.append(self.ratios(s[k : k + 2]))
                spots.append((m.start() + k, m.start() + k + 1))
        out: list[tuple[int, int, int]] = []
        if steps:
            n, k_states = len(steps), len(STATES)
            clean, best = 0.0, np.full(k_states, ENTER)
            came_clean = np.full(n, -1, int)
            came = np.zeros((n, k_states), bool)
            for t, r in enumerate(steps):
                into = clean + ENTER
                stay = best > into
                came[t] = stay
                best = np.where(stay, best, into) + r
                back = best + LEAVE
                j = int(back.argmax())
                if back[j] > clean:
                    clean = float(back[j])
                    came_clean[t] = j
            t, state = n - 1, -1
            j = int(best.argmax())
            if best[j] + LEAVE > clean:
                state = j
            elif came_clean[t] >= 0:
                state = int(came_clean[t])
            end = t
            while t >= 0:
                if state < 0:
                    if came_clean[t] >= 0:
                        state, end = int(came_clean[t]), t
                    else:
                        t -= 1
                        continue
                if came[t, state] and t > 0:
                    t -= 1
                    continue
                out.append((spots[t][0], spots[end][1] + 1, state))
                state = -1
                t -= 1
                end = t
            out.reverse()
        out.extend((m.start(), m.end(), len(STATES)) for m in re.finditer(LOST + "+", text))
        return out

    def repair(self, text: str) -> tuple[str, list[tuple[int, int, int, str]]]:
        """(text with every span's inverse transform, the spans with what replaced them).

        Runs in a span are undone one by one, since a broken one must not keep the others; up to
        DEPTH readings on top of one another. A span of which nothing can be undone and that holds
        no lost characters is no case and stays.
        """
        parts: list[str] = []
        found: list[tuple[int, int, int, str]] = []
        at = 0
        for start, end, state in self.label(text):
            if state == len(STATES):
                found.append((start, end, state, text[start:end]))
                continue
            if start < at:
                continue
            end = max(end, start)
            new = undo(text[start:end], STATES[state])
            if new is None or not (STATES[state][0] == GONE or self.better(new, text[start:end])):
                continue
            for _ in range(DEPTH - 1):
                more = [x for _, _, s in self.label(new) if s < len(STATES) and (x := undo(new, STATES[s])) is not None]
                again = max(more, key=self.fluency, default=None)
                if again is None or not self.better(again, new):
                    break
                new = again
            parts += [text[at:start], new]
            found.append((start, end, state, new))
            at = end
        parts.append(text[at:])
        return "".join(parts), found


HIGH = re.compile(r"[^\x00-\x7f]+")


def undo(span: str, state: tuple[tuple[str, str], ...]) -> str | None:
    """The inverse transform of the runs of a span; null if it fits none."""
    done = 0

    def one(m: re.Match) -> str:
        nonlocal done
        new = restored(m.group(0), state)
        if new is None or new == m.group(0):
            return m.group(0)
        done += 1
        return new

    text = HIGH.sub(one, span)
    return text if done else None


#: Codecs in which a line end may be part of a character.
NOT_BY_LINE = frozenset("utf-16 utf-16-le utf-16-be utf-32 utf-32-le utf-32-be utf-7".split())
#: Encodings of one byte a character in which bytes may be meant.
ONE_BYTE = tuple(dict.fromkeys(own for own, _ in PAIRS if own != "utf-8"))


def reread(data: bytes, codec: str, model: Model) -> tuple[str, list[dict]]:
    """(text with the lines of data that codec can't read read otherwise, what they were and became); markup counts as part of a line.

    A line is restored only if it reads better than with the marks; otherwise it keeps them.
    """
    lines = data.split(b"\n")
    texts = [read_as(line, codec) for line in lines]
    lost = [k for k, t in enumerate(texts) if LOST in t and LOST.encode() not in lines[k]]
    if not lost:
        return "\n".join(texts), []
    ways: dict[str, dict[int, str]] = {}
    for way in ("utf-8", *ONE_BYTE):
        if way == codec:
            continue
        for k in lost:
            try:
                ways.setdefault(way, {})[k] = lines[k].decode(way)
            except UnicodeDecodeError:
                pass
    sure = ways.pop("utf-8", {})
    left = [k for k in lost if k not in sure]
    best = max((w for w in ways if left and all(k in ways[w] for k in left)), key=lambda w: sum(model.fluency(plain(ways[w][k])) for k in left), default=None)
    found = []
    for k in lost:
        way, new = ("utf-8", sure[k]) if k in sure else (best, ways[best][k]) if best else (None, None)
        if new is not None and sum(b not in model.common for b in model._folded(new)) <= ODD * max(len(model._folded(new)), 1):
            found.append({"state": f"{way} read as {codec}", "n_chars": len(texts[k]), "before": texts[k], "after": new})
            texts[k] = new
    return "\n".join(texts), found


def fit(pages: DataFrame) -> Model:
    """The model of all pages. Collects the bigram table, which the alphabet bounds."""
    return Model({r.bigram: r.n for r in count_bigrams(pages).collect()})


def garbled_pages(records: DataFrame) -> DataFrame:
    """record_seq, spans (encoding pair, number of characters, before, after) and restored text of garbled pages.

    Null or empty payloads, other records and pages without garbled text give no row. Text inside
    code elements is not looked at. Repeated rows each give their row. Columns of the input other
    than those of the archive row schema are ignored.
    """
    pages = page_records(records)
    model = records.sparkSession.sparkContext.broadcast(fit(pages))  # bounded by the alphabet

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out: list[dict] = []
            for seq, *row in columns(batch, "record_seq", "payload", "ctype", "te", "ce"):
                data, codec = page_bytes(*row)
                text = read_as(data, codec)
                if text.isascii() and "&" not in text:
                    continue
                whole = text
                text = plain(text)
                if not m.may_be_garbled(text):
                    continue
                spans: list[dict] = []
                if LOST in text and codec not in NOT_BY_LINE:
                    whole, spans = reread(data, codec, m)
                    if spans:
                        text = plain(whole)
                        spans = spans if LOST in plain("\n".join(x["before"] for x in spans)) else []  # marks in quoted code are none
                new, found = m.repair(text)
                if found or spans:
                    spans += [{"state": name(s), "n_chars": b - a, "before": text[a:b], "after": x} for a, b, s, x in found]
                    out.append({"record_seq": seq, "spans": spans, "restored": new})
            if out:
                yield pa.RecordBatch.from_pylist(out, RESULT)

    return pages.mapInArrow(part, "record_seq bigint, spans array<struct<state string, n_chars bigint, before string, after string>>, restored string")


RESULT = pa.schema(
    [("record_seq", pa.int64()), ("spans", pa.list_(pa.struct([("state", pa.string()), ("n_chars", pa.int64()), ("before", pa.string()), ("after", pa.string())]))), ("restored", pa.string())]
)
