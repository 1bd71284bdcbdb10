"""A prose model: trigrams over function words and the runs of other words between them.

A line is a sequence of events. Each event is a function word (by group: article, preposition,
conjunction, pronoun, auxiliary, adverb) or the end of the line, together with the class of the run of
other words before it: how long it is, and whether it holds capitalised words or numbers. Prose has
short runs; keywords, names and tags in a row make long ones, which the model finds very unlikely.
The symbol set is fixed, so the model has at most ``N ** 3`` counts, whatever the size of the corpus:
it may be collected and shipped.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|\d+|\n")

#: Function words by group, over the languages of the crawl (en de fr es pl ru).
FUNCTION_WORDS = {
    "D": "a an the this that these those each every der die das den dem des ein eine einen einem einer dieser diese jede jeder jeden alle le la les l un une ce cette ces el los las una unos este esta cada todo todos ten ta to te każdy этот эта это все каждый",
    "P": "of in on at by to for from with between near since after before into over under about during within without per von in im am an auf aus bei mit nach seit zu zum zur um für über unter zwischen durch nördlich südlich de du dans à au aux en par pour sur sous avec entre près après depuis lors selon chez del al por para con sin desde hasta cerca según durante w we z ze na do od po o przy przez między dla koło pod nad ponad w из в во на с со к от до по о об при за для между около возле через под над без благодаря",
    "C": "and or but nor neither either than as if while because so though although whether und oder aber denn doch obwohl dass weil wie sondern et ou mais ni que qui si quand bien quoique y e o pero ni que aunque porque como cuando i a ale lub oraz że żeby choć gdzie które który и а но или что чтобы хотя если где как который",
    "O": "he she it they them their its his her we our you your who which what whose nobody someone er sie es sich wir ihr ihnen selbst man il elle on se s leur son sa ses rien qu se su sus lo le nada nadie quien się jego jej ich nic go on ona он она они его её их ничего кто себя",
    "V": "is was were are be been has had have do did does will would could should may must can said says took ist war waren wird wurde wurden hat hatte haben sind wären sein muss musste kann est était étaient a ont avait fut sera sont es fue era eran ha han son será está estaba jest był była było są będzie został została być był была было были есть будет",
    "A": "not no only more most less very still again once also too then there here half some any all nicht kein nur mehr sehr noch auch wieder dann heute fast plus moins très aussi encore ne pas où tout no más muy también ya todavía nie bardzo także również tylko już później potem не уже ещё тоже очень только затем потом более",
}

_GROUP = {w: k for k, words in reversed(list(enumerate(FUNCTION_WORDS.values()))) for w in words.split()}
#: Classes of tokens: the groups, then lower case, capitalised, number; the last ends a line.
GROUPS = len(FUNCTION_WORDS)
_LOWER, _CAPITAL, _NUMBER, _END = GROUPS, GROUPS + 1, GROUPS + 2, GROUPS + 3
#: Class of a run by its length (the last for all longer ones), without and with capitals, and with numbers.
_RUNS = np.array(
    [[0, 0, 0], [1, 2, 3], [4, 5, 5], [6, 7, 7], [6, 7, 7], [8, 9, 9], [8, 9, 9], *[[10, 10, 10]] * 3, *[[11, 11, 11]] * 6, [12, 12, 12]],
    np.int64,
)
RUNS = int(_RUNS.max()) + 1
#: How likely runs of each class are before anything is learnt.
_PRIOR = (8, 4, 4, 2, 4, 4, 2, 2, 0.7, 0.7, 0.2, 0.05, 0.01)
START = (GROUPS + 1) * RUNS
N = START + 1


class _Classes(dict):
    """token -> its class; new tokens are kept up to a bound."""

    def __missing__(self, token: str) -> int:
        if token == "\n":
            got = _END
        elif token[0].isdigit():
            got = _NUMBER
        else:
            got = _GROUP.get(token.lower())
            if got is None:
                got = _LOWER if token[0].islower() else _CAPITAL
        if len(self) < 300_000:
            self[token] = got
        return got


_class = _Classes().__getitem__


class Events(NamedTuple):
    """Trigram codes of the events of lines, one line after the other."""

    codes: np.ndarray
    #: where each line begins, and how many events, words and function words it has
    begins: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    function: np.ndarray


def events(lines: list[str]) -> Events:
    """Events of lines, none of which holds a line end."""
    if not lines:
        none = np.zeros(0, np.int64)
        return Events(none, none, none, none, none)
    a = np.array(list(map(_class, TOKEN.findall("\n".join([*lines, ""])))), np.int64)
    at = np.nonzero((a < GROUPS) | (a == _END))[0]
    kinds = a[at]
    ends = kinds == _END
    runs = []
    for mask in ((a >= GROUPS) & (a != _END), a == _CAPITAL, a == _NUMBER):
        upto = np.cumsum(mask)[at]
        runs.append(np.diff(upto, prepend=0))
    n, capitals, numbers = runs
    kind = np.where(numbers > 0, 2, np.where(capitals > 0, 1, 0))
    one = np.where(ends, GROUPS, kinds) * RUNS + _RUNS[np.minimum(n, len(_RUNS) - 1), kind]
    first = np.concatenate([[True], ends[:-1]])
    before = np.concatenate([[START], one[:-1]])
    before[first] = START
    second = np.concatenate([[START], before[:-1]])
    second[first] = START
    begins = np.nonzero(first)[0]
    sizes = np.diff(np.append(begins, len(one)))
    function = sizes - 1
    return Events((second * N + before) * N + one, begins, sizes, np.add.reduceat(n, begins) + function, function)


class Model(NamedTuple):
    """Log-probabilities by trigram code, and the perplexities between which a line is prose."""

    logs: np.ndarray
    low: float
    high: float

    def perplexities(self, lines: Events) -> np.ndarray:
        """Perplexity of each line."""
        return np.exp(-np.add.reduceat(self.logs[lines.codes], lines.begins) / lines.sizes) if len(lines.begins) else np.zeros(0)

    def normal(self, perplexity: np.ndarray) -> np.ndarray:
        return (perplexity >= self.low) & (perplexity <= self.high)


#: Lines drawn from the model, and the share of them that is left out at either end.
DRAWN, TAIL = 20_000, 0.002
#: How much further out, on the low and the high side, than the lines drawn those of prose may lie that the model did not learn from.
ROOM = 2.0, 1.5


def train(codes: np.ndarray, counts: np.ndarray, pull: float = 4.0) -> Model:
    """Counts of trigrams smoothed towards bigrams, and these towards symbols.

    The limits are quantiles of the perplexity of lines that are drawn from the trained model itself.
    """
    tri = np.zeros(N**3)
    np.add.at(tri, codes, counts)
    tri = tri.reshape(N, N, N)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    prior = np.append(np.tile(np.array(_PRIOR) / sum(_PRIOR), GROUPS + 1), 1e-3)
    p1 = (uni + 0.5 * prior) / (uni + 0.5 * prior).sum()
    p2 = (bi + pull * p1) / (bi.sum(1, keepdims=True) + pull)
    p3 = (tri + pull * p2[None]) / (tri.sum(2, keepdims=True) + pull)
    low, high = _limits(p3)
    return Model(np.log(p3).astype(np.float32).reshape(-1), low, high)


def _limits(p: np.ndarray) -> tuple[float, float]:
    """Quantiles of the perplexity of DRAWN lines of the model p."""
    rng = np.random.default_rng(11)
    steps = np.cumsum(p, 2)
    a = b = np.full(DRAWN, START)
    open_, logs, sizes = np.ones(DRAWN, bool), np.zeros(DRAWN), np.zeros(DRAWN)
    for _ in range(200):
        at = np.nonzero(open_)[0]
        if not len(at):
            break
        row = steps[a[at], b[at]]
        c = np.minimum((row < rng.random(len(at))[:, None] * row[:, -1:]).sum(1), N - 1)
        logs[at] += np.log(p[a[at], b[at], c])
        sizes[at] += 1
        a[at], b[at] = b[at], c
        open_[at] = c // RUNS < GROUPS
    low, high = np.quantile(np.exp(-logs / sizes), [TAIL, 1 - TAIL])
    return float(low / ROOM[0]), float(high * ROOM[1])
