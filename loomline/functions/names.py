"""Canonical names: equal names agree without regard to letter case and surrounding blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a name.
BLANKS = " \t\r\n\f\v"


def canonical(name: Column | str) -> Column:
    """Lower case, trimmed; null for null, empty and blank names."""
    c = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def uuid_key(text: Column | str) -> Column:
    """The 32 lower-case hex digits of a UUID, however it is written (urn:uuid:, braces, no dashes).

    Text that is no UUID is kept, lower case and trimmed, so that equal text still compares equal.
    """
    c = F.lower(F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS)))
    digits = F.translate(F.regexp_replace(c, "^urn:uuid:", ""), "{}-", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits).otherwise(c)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (without: UTC is meant)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))
