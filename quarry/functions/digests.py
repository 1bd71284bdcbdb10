"""Digests as column expressions; base 32 is computed from the hexadecimal form by five bytes at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Bytes of the digests known to the expressions.
SIZES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}


def base32_of_hex(hexa: Column, size: int) -> Column:
    """Base 32, padded, of a hexadecimal text of so many bytes."""
    groups = []
    for at in range(0, size, 5):
        n = min(5, size - at)
        digits = {5: 8, 4: 7, 3: 5, 2: 4, 1: 2}[n]
        piece = F.rpad(F.substring(hexa, at * 2 + 1, n * 2), 10, "0")
        text = F.lpad(F.conv(piece, 16, 32), 8, "0")
        groups.append(F.concat(F.substring(text, 1, digits), F.lit("=" * (8 - digits))))
    return F.translate(F.concat(*groups), _CONV, ALPHABET)


def _hash(data: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    return F.sha2(data, int(algorithm[3:]))


def digest_of(data: Column | str, algorithm: str = "sha1") -> Column:
    """``algorithm:BASE32`` of binary or text."""
    d = F.col(data) if isinstance(data, str) else data
    return F.concat(F.lit(algorithm + ":"), base32_of_hex(_hash(d.cast("binary"), algorithm), SIZES[algorithm]))


def _base32(hexa: Column, size: Column) -> Column:
    """Base 32, padded, of a hexadecimal text of so many bytes, where the size differs by row."""
    groups = F.ceil(size / 5).cast("int")
    piece = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.lpad(F.conv(F.rpad(F.substring(hexa, g * 10 + 1, F.lit(10)), 10, "0"), 16, 32), 8, "0"))
    text = F.translate(F.array_join(piece, ""), _CONV, ALPHABET)
    digits = F.ceil(size * 8 / 5).cast("int")
    return F.concat(F.substring(text, F.lit(1), digits), F.repeat(F.lit("="), groups * 8 - digits))


def digest_matches(declared: Column | str, data: Column | str) -> Column:
    """Whether a declared digest is that of data; null for no digest, no algorithm, or an unknown one.

    As long as base 32, the value is compared so, in this case; longer as hexadecimal in any case;
    shorter as base 64 in either alphabet.
    """
    text = F.col(declared) if isinstance(declared, str) else declared
    d = (F.col(data) if isinstance(data, str) else data).cast("binary")
    algorithm, value = F.lower(F.substring_index(text, ":", 1)), F.substring(text, F.instr(text, ":") + 1, F.length(text))
    hashed, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, n in SIZES.items():
        hashed = F.when(algorithm == name, _hash(d, name)).otherwise(hashed)
        size = F.when(algorithm == name, n).otherwise(size)
    width = F.ceil(size / 5) * 8
    same = (
        F.when(F.length(value) > width, F.lower(value) == hashed)
        .when(F.length(value) < width, F.translate(value, "-_", "+/") == F.translate(F.base64(F.unhex(hashed)), "\r\n", ""))
        .otherwise(value == _base32(hashed, size))
    )
    return F.when((F.instr(text, ":") > 0) & d.isNotNull() & hashed.isNotNull(), same)
