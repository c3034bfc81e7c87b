"""Log templates and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telespark.functions.labels import UNKNOWN

_HEX = "[0-9a-fA-F]"
#: What is masked, in this order: quoted text, addresses with or without port, UUIDs, hexadecimal tokens of eight digits or
#: more with a letter among them, runs of digits, white space.
MASKS = (
    (r"\"[^\"]*\"|'[^']*'", "<STR>"),
    (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b", "<IP>"),
    (rf"\b{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\b", "<HEX>"),
    (rf"\b(?:0x)?(?={_HEX}{{8,}}\b)[0-9]*[a-fA-F]{_HEX}*\b", "<HEX>"),
    (r"[0-9]+", "<NUM>"),
    (r"\s+", " "),
)


def fingerprint(body: Column) -> Column:
    """The template of a log body: its variable parts masked."""
    for pattern, mask in MASKS:
        body = F.regexp_replace(body, pattern, mask)
    return F.trim(body)


def severity_label(text: Column, number: Column) -> Column:
    """The severity's text, else its positive number, else ``unknown``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.when(number > 0, number.cast("string")), F.lit(UNKNOWN))


def is_debug(number: Column) -> Column:
    """Severities of trace and debug: above 0 and below 9."""
    return number.between(1, 8)
