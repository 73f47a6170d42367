"""Intervals and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Upper bounds (inclusive) of year errors and their names; from 0 exclusive.
YEAR_BUCKETS = ((1, "0-1"), (5, "2-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (5000, "500+"))


def left_closed(x: Column | str, width: int) -> Column:
    """Lower edge of the interval [a, a + width) that holds x."""
    return (F.floor(col(x) / width) * width).cast("long")


def interval(lo: Column | str, width: int) -> Column:
    return F.format_string("[%d, %d)", col(lo), col(lo) + width)


def edges(lo: int, hi: int, width: int) -> list[int]:
    """Edges from the interval of lo to one beyond that of hi, so that the last holds hi."""
    if width <= 0:
        raise ValueError("width must be positive")
    return list(range(lo // width * width, (hi // width + 2) * width + 1, width))


def year_bucket(diff: Column | str) -> Column:
    """The right-closed bucket of a year error; null for 0 and beyond the last."""
    out = F.when(col(diff) <= 0, F.lit(None))
    for top, name in YEAR_BUCKETS:
        out = out.when(col(diff) <= top, name)
    return out


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, 0.0 where d is 0."""
    return F.when(col(d) > 0, col(n).cast("double") / col(d)).otherwise(0.0)
