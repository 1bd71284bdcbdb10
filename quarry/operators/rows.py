"""Rows that fail to parse.

A delimited row is cut into fields by built-in string functions: splitting it at the quotes leaves
the text outside of them at the even places, where separators are exchanged for a character that
does not occur, and the row is put together and cut again. All columns are nullable text first;
cast and constraint rules, all of them column expressions, give an array of reasons, and rows are
told apart by that array being empty. Everything stays in one projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a separator outside of quotes; rows that contain it themselves are not valid.
CUT = "\x01"


class Field(NamedTuple):
    """A field of the row: its name, its type once valid, and rules as pairs of a reason and what the trimmed value must fulfil."""

    name: str
    type: str = "string"
    rules: Sequence[tuple[str, Callable[[Column], Column]]] = ()
    trim: bool = False


def one_of(*values: str) -> tuple[str, Callable[[Column], Column]]:
    """The value is one of these, in this spelling."""
    return "unknown value", lambda c: c.isin(*values)


def natural() -> tuple[str, Callable[[Column], Column]]:
    """The value is empty, or digits alone that fit a signed 64-bit integer."""
    return "not a number", lambda c: (c == "") | (c.rlike("^[0-9]+$") & c.try_cast("bigint").isNotNull())


def fields_of(line: Column, separator: str = ",", quote: str = '"') -> Column:
    """The fields of a row as they stand, quotes included; a separator or line end inside quotes does not end one."""
    pieces = F.split(line, "\\Q" + quote + "\\E", -1)
    outside = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.translate(p, separator, CUT)).otherwise(p))
    return F.split(F.array_join(outside, quote), CUT, -1)


def well_quoted(field: Column, quote: str = '"') -> Column:
    """A field without quotes and line ends, or one in quotes that are doubled inside."""
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit(quote * 2), F.lit(""))
    quoted = F.startswith(field, F.lit(quote)) & F.endswith(field, F.lit(quote)) & (F.length(field) >= 2) & ~F.contains(inner, F.lit(quote))
    return F.when(F.contains(field, F.lit(quote)), quoted).otherwise(~F.contains(field, F.lit("\n")))


def unquoted(field: Column, quote: str = '"') -> Column:
    """Value of a well quoted field."""
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit(quote * 2), F.lit(quote))
    return F.when(F.startswith(field, F.lit(quote)), inner).otherwise(field)


def checked(rows: DataFrame, line: str, fields: Sequence[Field], separator: str = ",", quote: str = '"') -> DataFrame:
    """The columns of rows, the struct ``values`` of nullable text, and ``reasons``: empty for a valid row.

    A null line is a row without fields. Fields beyond the last or before the first wanted are not
    guessed: with a wrong number of them all values are null.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), "\r\\z", "")
    cut = rows.withColumn("_fields", fields_of(text, separator, quote)).withColumn(
        "_quoting", ~F.contains(text, F.lit(CUT)) & (F.size(F.split(text, "\\Q" + quote + "\\E", -1)) % 2 == 1) & F.forall("_fields", lambda f: well_quoted(f, quote))
    )
    good = F.col("_quoting") & (F.size("_fields") == len(fields))
    values = []
    for k, f in enumerate(fields):
        value = unquoted(F.get("_fields", F.lit(k)), quote)
        if f.trim:
            value = F.regexp_replace(value, r"\A[ \t]+|[ \t]+\z", "")
        values.append(F.when(good, value).alias(f.name))
    tested = cut.withColumn("values", F.struct(*values))
    reasons = [
        F.when(~F.col("_quoting"), F.lit("broken quoting")),
        F.when(F.col("_quoting") & (F.size("_fields") != len(fields)), F.concat(F.size("_fields").cast("string"), F.lit(f" fields instead of {len(fields)}"))),
    ]
    for f in fields:
        for reason, rule in f.rules:
            value = F.col("values")[f.name]
            reasons.append(F.when(good & ~F.coalesce(rule(value), F.lit(False)), F.lit(f"{f.name}: {reason}")))
    return tested.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("_fields", "_quoting")


def valid_rows(tested: DataFrame, fields: Sequence[Field], *keep: str) -> DataFrame:
    """The valid rows with typed columns; empty text of another type than string is null."""
    typed = [F.when(F.col("values")[f.name] != "", F.col("values")[f.name]).try_cast(f.type).alias(f.name) if f.type != "string" else F.col("values")[f.name].alias(f.name) for f in fields]
    return tested.filter(F.size("reasons") == 0).select(*keep, *typed)


def invalid_rows(tested: DataFrame, *keep: str) -> DataFrame:
    """The rows that are not valid, with the reasons."""
    return tested.filter(F.size("reasons") > 0).select(*keep, "reasons")


#: Record types of the format; fixed values.
WARC_TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: The fields of an index line.
INDEX_LINE = (
    Field("record_id"),
    Field("warc_type", rules=[one_of(*WARC_TYPES)], trim=True),
    Field("warc_target_uri"),
    Field("warc_date"),
    Field("content_type"),
    Field("content_length", "bigint", [natural()], trim=True),
    Field("warc_payload_digest"),
)
