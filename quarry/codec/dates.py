"""Timestamps of 14 digits (worker code); the column functions are in quarry.functions.dates."""

from __future__ import annotations

import calendar


def clamped(stamp: str) -> tuple[int, int, int, int, int, int]:
    """Year to second of a timestamp: what is missing, cut or no number takes its greatest value, the rest is brought into range."""
    stamp += "299912"[len(stamp) :]

    def part(at: int, end: int, low: int, high: int) -> int:
        text = stamp[at:end]
        try:
            return max(low, min(int(text), high)) if len(text) == end - at else high
        except ValueError:
            return high

    year, month = part(0, 4, 1900, 2999), part(4, 6, 1, 12)
    return year, month, part(6, 8, 1, calendar.monthrange(year, month)[1]), part(8, 10, 0, 23), part(10, 12, 0, 59), part(12, 14, 0, 59)


def timestamp_to_iso_date(stamp: str) -> str:
    return "%04d-%02d-%02dT%02d:%02d:%02dZ" % clamped(stamp)
