"""{{ name }} placeholders in task bodies."""

from __future__ import annotations

import re

_PLACE = re.compile(r"\{\{(.*?)\}\}", re.S)


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def literal(value: str) -> str:
    """Numbers and text that begins with a quote stand as they are, anything else as a quoted string."""
    if value.startswith("'") or is_number(value):
        return value
    return "'" + value.replace("'", "''") + "'"


def substitute(text: str, values: dict[str, str]) -> str:
    """Fill known placeholders; unknown ones and an opening without a close stay."""
    return _PLACE.sub(lambda m: literal(values[m[1].strip()]) if m[1].strip() in values else m[0], text)


def placeholders_to_literals(text: str) -> str:
    """Any literal for each placeholder, so that the text can be parsed."""
    return _PLACE.sub("TIMESTAMP '1970-01-01 00:00:00'", text)
