"""Small builders for the check SQL."""

from __future__ import annotations

from evalweave.functions.text import WHITESPACE, WS

_CHARS = WHITESPACE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(_CHARS)})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {lit(_CHARS)})"


def strip_or_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def after_last(x: str, needle: str) -> str:
    return f"string_split({x}, {lit(needle)})[-1]"


def before_first(x: str, needle: str) -> str:
    return f"string_split({x}, {lit(needle)})[1]"


def count_of(x: str, needle: str) -> str:
    return f"(len(string_split({x}, {lit(needle)})) - 1)"


def uniform(*parts: str) -> str:
    """The hash uniform of the given SQL expressions."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST(concat('0x', substr(md5({key}), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def ints(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda v: coalesce(CAST(v AS VARCHAR), 'null')), ','), '')"


def ctes(**parts: str) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()) + " "


WS_CLASS = WS
