"""Encoding pairs: which text comes from reading bytes of one encoding as another."""

from __future__ import annotations

from functools import lru_cache

#: (encoding of the bytes, encoding they were read in), by name in Python.
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1250"),
    ("utf-8", "iso8859-2"),
    ("utf-8", "cp1251"),
    ("utf-8", "koi8-r"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "cp866"),
    ("utf-8", "mac-roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "mac-roman"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8-r"),
    ("cp1250", "cp1252"),
    ("iso8859-2", "cp1252"),
    ("iso8859-2", "latin-1"),
    ("iso8859-2", "cp437"),
    ("iso8859-2", "mac-roman"),
    ("cp1251", "cp1252"),
    ("cp1251", "latin-1"),
    ("cp1251", "koi8-r"),
    ("cp1251", "cp866"),
    ("cp1251", "mac-roman"),
    ("koi8-r", "cp1251"),
    ("koi8-r", "cp1252"),
    ("koi8-r", "latin-1"),
    ("koi8-r", "cp866"),
    ("koi8-r", "mac-roman"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("iso8859-5", "cp1251"),
    ("mac-roman", "cp1252"),
    ("mac-roman", "latin-1"),
)
#: States of the model: readings one after the other. Twice the same is the common accident of a text stored twice.
#: GONE stands for a reading that left only replacement marks; they in turn may have been read wrongly.
LOST = "\ufffd"
GONE = ("gone", "gone")
STATES = (
    tuple((p,) for p in PAIRS)
    + tuple((p, p) for p in (("utf-8", "cp1252"), ("utf-8", "latin-1")))
    + tuple((GONE, ("utf-8", n)) for n in ("cp1252", "latin-1", "cp1251"))
)
#: At most so many readings on top of one another are undone.
DEPTH = 3


def name(state: int) -> str:
    """Name of a state; one past the last is that of lost characters."""
    return ", ".join(f"{a} read as {b}" for a, b in STATES[state]) if state < len(STATES) else "lost"


@lru_cache(None)
def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """byte -> character and back of a one-byte encoding; unassigned bytes stand for the C1 controls."""
    there = {}
    for b in range(128, 256):
        try:
            there[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            there[b] = chr(b)
    back = {}
    for b, c in there.items():
        back.setdefault(c, b)
    return there, back


@lru_cache(None)
def letters(state: tuple[tuple[str, str], ...]) -> frozenset[str]:
    """Characters outside ASCII that the last reading of a state can give; others can't have come from it."""
    return frozenset(_tables(state[-1][1])[1])


def garbled(text: str, state: tuple[tuple[str, str], ...]) -> str | None:
    """What a text looks like after wrong readings; null if it can't be written in the encoding they start from."""
    for own, read in state:
        if (own, read) == GONE:
            text = "".join(c if c < "\x80" else LOST for c in text)
            continue
        try:
            data = text.encode(own)
        except UnicodeEncodeError:
            return None
        there = _tables(read)[0]
        text = "".join(there[b] if b > 127 else chr(b) for b in data)
    return text


def restored(text: str, state: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the wrong readings; null where it can't have come from them."""
    for own, read in reversed(state):
        if (own, read) == GONE:
            return text if set(text) <= {LOST} else None
        back = _tables(read)[1]
        data = bytearray()
        for c in text:
            b = ord(c) if c < "\x80" else back.get(c)
            if b is None:
                return None
            data.append(b)
        try:
            text = data.decode(own)
        except UnicodeDecodeError:
            return None
    return text
