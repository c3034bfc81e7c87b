"""The 32-bit polynomial string hash, and sampling by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: Characters that are cut out of a text at a time: a text is walked through from its start for each cut.
_CHUNK = 128


def _added(h: Column, c: Column) -> Column:
    return (h * 31 + c).bitwiseAND(F.lit(_MASK))


def string_hash(text: Column) -> Column:
    """The sum of code * 31 ** (n - 1 - i) over the UTF-16 codes, modulo 2 ** 32, as an unsigned long."""

    def of_part(h: Column, part: Column) -> Column:
        def of_char(a: Column, i: Column) -> Column:
            c = F.ascii(F.substring(part, i, F.lit(1)))
            high, low = F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
            return F.when(c > 0xFFFF, _added(_added(a, high), low)).otherwise(_added(a, c))

        n = F.length(part)
        return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), h, of_char)

    chunks = F.sequence(F.lit(0), F.floor(F.length(text) / _CHUNK).cast("int"))
    parts = F.transform(chunks, lambda k: F.substring(text, k * _CHUNK + 1, F.lit(_CHUNK)))
    return F.aggregate(parts, F.lit(0).cast("long"), of_part)


def hash_hex(text: Column) -> Column:
    return F.lower(F.hex(string_hash(text)))


def sampled(text: Column, percent: int = 5) -> Column:
    """True for about ``percent`` in a hundred keys: the signed hash's magnitude modulo 100 is below it.

    The least signed value has no positive magnitude; it stays negative and is sampled.
    """
    h = string_hash(text)
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return (signed == -(1 << 31)) | (F.abs(signed) % 100 < percent)
