"""Functions over header arrays: ordered multimaps of (name, value) structs, names in any case.

All are built-in expressions, so they stay in whole-stage code generation or at least on the JVM.
Null arrays are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import HEADERS


def _headers(headers: Column | str) -> Column:
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.coalesce(h, F.array().cast(HEADERS))


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _is(name: Column | str) -> Callable[[Column], Column]:
    low = F.lit(name.lower()) if isinstance(name, str) else F.lower(name)
    return lambda h: F.lower(h["name"]) == low


def get_header(headers: Column | str, name: Column | str, default: Column | str | None = None) -> Column:
    """First value of a header."""
    value = F.get(F.filter(headers, _is(name)), F.lit(0))["value"]
    return value if default is None else F.coalesce(value, _text(default))


def has_header(headers: Column | str, name: Column | str) -> Column:
    """Whether a header has a value that is not empty."""
    return F.coalesce(get_header(headers, name), F.lit("")) != ""


def header(name: Column | str, value: Column | str) -> Column:
    """A struct of name and value."""
    return F.struct(_text(name).alias("name"), _text(value).cast("string").alias("value"))


def add_header(headers: Column | str, name: Column | str, value: Column | str) -> Column:
    """Header appended."""
    return F.concat(_headers(headers), F.array(header(name, value)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(headers: Column, name: Column | str) -> Column:
    """Place from 0 of the last header of a name; -1 if absent."""
    same = _is(name)
    return F.coalesce(F.array_max(F.transform(headers, lambda h, i: F.when(same(h), i).otherwise(-1))), F.lit(-1))


def replace_header(headers: Column | str, name: Column | str, value: Column | str) -> Column:
    """The last header of a name with another value, its name as it was spelled; appended if absent."""
    new = _text(value).cast("string")

    def replaced(h: Column) -> Column:
        def at(k: Column) -> Column:
            kept = F.transform(h, lambda x, i: F.when(i == k, F.struct(x["name"].alias("name"), new.alias("value"))).otherwise(x))
            return F.when(k < 0, F.concat(h, F.array(header(name, value)))).otherwise(kept)

        return _let(_last(h, name), at)

    return _let(_headers(headers), replaced)


def remove_header(headers: Column | str, name: Column | str) -> Column:
    """Without the last header of a name."""
    return _let(_headers(headers), lambda h: _let(_last(h, name), lambda k: F.filter(h, lambda _, i: i != k)))


def filter_headers(headers: Column | str, keep: Callable[[Column], Column]) -> Column:
    """Headers for which keep(struct) is true."""
    return F.filter(_headers(headers), keep)


def status_code(statusline: Column | str) -> Column:
    """Text before the first blank of a status line."""
    return F.substring_index(statusline, " ", 1)


def valid_statusline(statusline: Column | str, valid: Column | str) -> Column:
    """The status line if it starts with a positive number, else the valid one."""
    line = F.col(statusline) if isinstance(statusline, str) else statusline
    return F.when(status_code(line).try_cast("int") > 0, line).otherwise(_text(valid))


def add_range(headers: Column | str, start: Column | int, part_len: Column | int, total_len: Column | int) -> Column:
    """struct(statusline, headers) of a partial response."""
    s, p, t = (F.lit(x) if isinstance(x, int) else x for x in (start, part_len, total_len))
    span = F.concat(F.lit("bytes "), s.cast("string"), F.lit("-"), (s + p - 1).cast("string"), F.lit("/"), t.cast("string"))
    h = replace_header(replace_header(replace_header(headers, "Content-Range", span), "Content-Length", p.cast("string")), "Accept-Ranges", "bytes")
    return F.struct(F.lit("206 Partial Content").alias("statusline"), h.alias("headers"))


def not_empty(statusline: Column | str, headers: Column | str) -> Column:
    """Whether a block has a status line or headers."""
    return (F.coalesce(F.col(statusline) if isinstance(statusline, str) else statusline, F.lit("")) != "") | (F.size(_headers(headers)) > 0)


def block_text(protocol: Column | str, statusline: Column | str, headers: Column | str) -> Column:
    """The block as text, without its blank line."""
    p, s = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (protocol, statusline))
    top = F.concat(p, F.when((p != "") & (s != ""), " ").otherwise(""), s)
    lines = F.transform(_headers(headers), lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n")))
    return F.concat(top, F.when(top != "", "\r\n").otherwise(""), F.array_join(lines, ""))


def block_bytes(protocol: Column | str, statusline: Column | str, headers: Column | str) -> Column:
    """The block as UTF-8 with its blank line."""
    return F.encode(F.concat(block_text(protocol, statusline, headers), F.lit("\r\n")), "UTF-8")


def decode_header(raw: Column | str) -> Column:
    """Text of a header line: UTF-8 where valid, else ISO-8859-1."""
    b = F.col(raw) if isinstance(raw, str) else raw
    return F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(F.decode(b, "ISO-8859-1"))


def parse_block(text: Column | str) -> Column:
    """struct(protocol, statusline, headers) of a header block given as text.

    Lines lose white space at the end; the first colon splits; a line without one is dropped with
    its continuations, which begin with a blank and are appended as they are. The block ends at the
    first empty line. An empty first line is an empty block.
    """
    t = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, r"\s+\z", ""))
    first = F.get(lines, F.lit(0))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(rest, "")
    rest = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(rest)
    empty = F.struct(F.array().cast(HEADERS).alias("h"), F.lit(False).alias("open"), F.lit(True).alias("top"))

    def step(acc: Column, line: Column) -> Column:
        cont = line.rlike(r"\A[ \t]") & ~acc["top"]
        last = F.element_at(acc["h"], -1)
        grown = F.concat(F.slice(acc["h"], F.lit(1), F.size(acc["h"]) - 1), F.array(F.struct(last["name"].alias("name"), F.concat(last["value"], line).alias("value"))))
        name = F.regexp_replace(F.substring_index(line, ":", 1), r"[ \t]+\z", "")
        value = F.regexp_replace(F.substring(line, F.instr(line, ":") + 1, F.length(line)), r"\A\s+", "")
        colon = F.instr(line, ":") > 0
        h = F.when(cont & acc["open"], grown).when(~cont & colon, F.concat(acc["h"], F.array(F.struct(name.alias("name"), value.alias("value"))))).otherwise(acc["h"])
        return F.struct(h.alias("h"), F.when(cont, acc["open"]).otherwise(colon).alias("open"), F.lit(False).alias("top"))

    folded = F.aggregate(rest, empty, step)
    protocol = F.substring_index(first, " ", 1)
    status = F.trim(F.when(F.instr(first, " ") > 0, F.substring(first, F.instr(first, " ") + 1, F.length(first))).otherwise(F.lit("")))
    return F.when(first == "", F.struct(F.lit("").alias("protocol"), F.lit("").alias("statusline"), F.array().cast(HEADERS).alias("headers"))).otherwise(
        F.struct(protocol.alias("protocol"), status.alias("statusline"), folded["h"].alias("headers"))
    )
