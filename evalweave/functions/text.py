"""String expressions with the whitespace and search rules of Python text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a regex character class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_BUT_SPACE = WS.replace(r"\x1c-\x20", r"\x1c-\x1f")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(WHITESPACE))


def strip_or_null(c: Column | str) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def has(c: Column | str, needle: str) -> Column:
    return F.contains(col(c), F.lit(needle))


def after_last(c: Column | str, needle: str) -> Column:
    """Text right of the last `needle`; the whole text when it is absent."""
    return F.substring_index(col(c), needle, -1)


def before_first(c: Column | str, needle: str) -> Column:
    """Text left of the first `needle`; the whole text when it is absent."""
    return F.substring_index(col(c), needle, 1)


def before_last(c: Column | str, needle: str) -> Column:
    """Text left of the last `needle` (which must be present)."""
    c = col(c)
    return F.left(c, F.length(c) - F.length(after_last(c, needle)) - F.lit(len(needle)))


def count_of(c: Column | str, needle: str) -> Column:
    """Number of non-overlapping occurrences."""
    c = col(c)
    gone = F.replace(c, F.lit(needle), F.lit(""))
    return ((F.length(c) - F.length(gone)) / F.lit(len(needle))).cast("int")


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of white space as one space; single spaces are not touched."""
    return strip(F.regexp_replace(col(c), f"[{WS_BUT_SPACE}][{WS}]*| [{WS}]+", " "))


def char_at(c: Column | str, pos: int) -> Column:
    """The character at a 1-based position, '' beyond the end."""
    return F.substring(col(c), pos, 1)


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def contains_any(c: Column | str, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | has(c, n)
    return out


def words(c: Column | str) -> Column:
    """Blank-separated words of a text."""
    return F.filter(F.split(col(c), r"[ \t\n\r]+"), lambda w: w != "")
