"""Digests of blocks and payloads and the verdict over them (worker code)."""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Callable
from typing import NamedTuple


class Verdict(NamedTuple):
    """passed: null if nothing was judged."""

    passed: bool | None
    problems: list[str]


def digest_of(data: bytes, algorithm: str = "sha1") -> str:
    """``algorithm:BASE32`` of data."""
    return f"{algorithm}:{base64.b32encode(hashlib.new(algorithm, data).digest()).decode()}"


def _from_64(value: str) -> bytes:
    return base64.b64decode(value.translate(str.maketrans("-_", "+/")), validate=True)


def spellings(size: int) -> dict[int, Callable[[str], bytes]]:
    """Length of a digest of so many bytes in each encoding -> how it is read; hexadecimal goes in any case."""
    return {4 * -(-size // 3): _from_64, 8 * -(-size // 5): base64.b32decode, 2 * size: bytes.fromhex}


def raw_digest(value: str, size: int) -> bytes | None:
    """The bytes that a digest's text stands for; null if it is no text of so many bytes."""
    read = spellings(size).get(len(value))
    try:
        return read(value) if read else None
    except (binascii.Error, ValueError):
        return None


def matches(declared: str, data: bytes) -> bool | None:
    """Whether a declared digest is that of data; null for an unknown algorithm or a value without one."""
    algorithm, colon, value = declared.partition(":")
    if not colon or not _known(algorithm):
        return None
    own = hashlib.new(algorithm, data).digest()
    return raw_digest(value, len(own)) == own


def verdict(block: bytes | None, payload: bytes | None, block_digest: str | None, payload_digest: str | None, rec_type: str | None, segment: str | None = None, complete: bool = True) -> Verdict:
    """Judge the digests of a record.

    Revisits are not judged, segments only by block. Nothing is judged of a block that is not
    complete, and no block digest of an empty block.
    """
    if rec_type == "revisit":
        block_digest = payload_digest = None
    if segment is not None:
        payload_digest = None
    problems: list[str] = []
    good = bad = False
    for kind, declared, data in (("block", block_digest, block), ("payload", payload_digest, payload)):
        if not declared:
            continue
        algorithm, colon, _ = declared.partition(":")
        if not colon or not _known(algorithm):
            problems.append(f"unknown hash algorithm name in {kind} digest")
            bad = True
            continue
        if not complete or data is None or kind == "block" and not data:
            continue
        ok = matches(declared, data)
        if ok:
            good = True
        elif ok is False:
            bad = True
            colon_ = ":" if kind == "block" or not data else ""
            problems.append(f"{kind} digest failed{colon_} {declared}")
    return Verdict(False if bad else True if good else None, problems)


def _known(algorithm: str) -> bool:
    try:
        hashlib.new(algorithm)
        return True
    except (ValueError, TypeError):
        return False
