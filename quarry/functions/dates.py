"""Dates in the forms of archives: ISO 8601, 14 digits, HTTP, seconds. Times are UTC without a zone.

The session's time zone must be UTC for the functions of seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _stamp(parts: list[Column]) -> Column:
    """timestamp_ntz of year, month, day, hour, minute and second (decimal text); null if there is no such time."""
    text = F.format_string("%s-%s-%s %s:%s:%s", *(F.lpad(p, 4 if k == 0 else 2, "0") for k, p in enumerate(parts[:5])), parts[5])
    return F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), text).try_cast("timestamp_ntz")


def iso_to_time(text: Column | str) -> Column:
    """Time of an ISO date: numbers by place, offsets not understood, fractions cut at micros; missing time is zero."""
    n = F.regexp_extract_all(_c(text), F.lit(r"(\d+)"), F.lit(1))
    at = [F.get(n, F.lit(k)) for k in range(7)]
    second = F.concat(F.lpad(F.coalesce(at[5], F.lit("0")), 2, "0"), F.lit("."), F.rpad(F.substring(F.coalesce(at[6], F.lit("0")), 1, 6), 6, "0"))
    return _stamp([at[0], at[1], at[2], F.coalesce(at[3], F.lit("0")), F.coalesce(at[4], F.lit("0")), second])


def http_to_time(text: Column | str) -> Column:
    """Time of an HTTP date, with or without the day of the week; the zone is ignored."""
    pattern = r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    part = [F.nullif(F.regexp_extract(_c(text), pattern, k), F.lit("")) for k in range(1, 7)]
    month = F.nullif(F.array_position(F.array(*(F.lit(m.lower()) for m in _MONTHS)), F.lower(part[1])), F.lit(0)).cast("string")
    short = part[2].try_cast("int")
    year = F.when(F.length(part[2]) == 2, F.when(short < 69, short + 2000).otherwise(short + 1900).cast("string")).otherwise(part[2])
    return _stamp([year, month, part[0], part[3], part[4], F.lpad(F.coalesce(part[5], F.lit("0")), 2, "0")])


def time_to_http(time: Column | str) -> Column:
    """``Thu, 26 Dec 2013 09:50:10 GMT``."""
    return F.date_format(_c(time).cast("timestamp_ntz"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def time_to_iso(time: Column | str, micros: bool = False) -> Column:
    """ISO date; with micros the fraction is written unless it is zero."""
    t = _c(time).cast("timestamp_ntz")
    short = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if not micros:
        return short
    return F.when(F.date_format(t, "SSSSSS") == "000000", short).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def time_to_timestamp(time: Column | str) -> Column:
    """14 digits."""
    return F.date_format(_c(time).cast("timestamp_ntz"), "yyyyMMddHHmmss")


def timestamp_now() -> Column:
    """14 digits of the present time."""
    return F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")


def timestamp20_now() -> Column:
    """20 digits of the present time."""
    return F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS")


def pad_timestamp(text: Column | str, pad: str = "299912") -> Column:
    """A timestamp shorter than pad, with the end of pad."""
    t = _c(text)
    return F.concat(t, F.substring(F.lit(pad), F.length(t) + 1, len(pad)))


def timestamp_to_time(text: Column | str) -> Column:
    """Time of up to 14 digits: what is missing or no number is the greatest value, the rest is brought into range."""
    t = pad_timestamp(text)

    def clamped(at: int, end: int, low: int, high: Column) -> Column:
        number = F.substring(t, at + 1, end - at).try_cast("int")
        inside = F.when(number.isNull(), high).otherwise(F.greatest(F.lit(low), F.least(number, high)))
        return F.when(F.length(t) >= end, inside).otherwise(high)

    year, month = clamped(0, 4, 1900, F.lit(2999)), clamped(4, 6, 1, F.lit(12))
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    day = clamped(6, 8, 1, last)
    clock = [clamped(8, 10, 0, F.lit(23)), clamped(10, 12, 0, F.lit(59)), clamped(12, 14, 0, F.lit(59))]
    return F.when(_c(text).isNotNull(), F.make_timestamp_ntz(year, month, day, *clock))


def timestamp_to_seconds(text: Column | str) -> Column:
    return F.unix_timestamp(timestamp_to_time(text).cast("timestamp"))


def seconds_to_timestamp(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(seconds)), "yyyyMMddHHmmss")


def iso_to_timestamp(text: Column | str) -> Column:
    return time_to_timestamp(iso_to_time(text))


def timestamp_to_iso(text: Column | str) -> Column:
    return time_to_iso(timestamp_to_time(text))


def http_to_timestamp(text: Column | str) -> Column:
    return time_to_timestamp(http_to_time(text))


def timestamp_to_http(text: Column | str) -> Column:
    return time_to_http(timestamp_to_time(text))
