"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(arr: Column, n: Column | int) -> Column:
    """The first n items (none when n <= 0)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(arr, 1, F.greatest(n, F.lit(0)).cast("int"))


def tail_from(arr: Column, start: Column | int) -> Column:
    """Items from a 0-based position on."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.slice(arr, (start + 1).cast("int"), F.greatest(F.size(arr) - start, F.lit(0)).cast("int"))


def last_n(arr: Column, n: Column | int) -> Column:
    """The last n items (the whole array when it is shorter, none when n <= 0)."""
    n = n if isinstance(n, Column) else F.lit(n)
    keep = F.greatest(F.least(n, F.size(arr)), F.lit(0)).cast("int")
    return F.slice(arr, (F.size(arr) - keep + 1).cast("int"), keep)


def fill(value, n: Column) -> Column:
    """n copies of an int value (none when n <= 0)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.array_repeat(v, F.greatest(n, F.lit(0)).cast("int"))


def first_position(arr: Column, pred) -> Column:
    """0-based position of the first item for which `pred` holds, NULL if none."""
    return F.nullif(F.array_position(F.transform(arr, pred), F.lit(True)), F.lit(0)) - 1


def join_ints(arr: Column) -> Column:
    """Items as one comma-separated text, for display and comparison."""
    return F.array_join(arr.cast("array<string>"), ",", "null")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once per row.

    A column used inside a lambda is put into the lambda by the optimizer and
    would run again for every item.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def put_where(arr: Column | str, hits: Column | str, value: int) -> Column:
    """The array with `value` where the boolean array is true."""
    return F.zip_with(arr, hits, lambda x, m: F.when(m, value).otherwise(x))
