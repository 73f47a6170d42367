"""Dates as strings: parts are compared as text, so a date that no calendar has stays comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip

PARTS = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"


def whole_date(x: Column | str) -> Column:
    """A text that is a date, up to its first T, as YYYY-MM-DD; else ''."""
    return F.regexp_extract(F.substring_index(strip(x), "T", 1), rf"^{PARTS}\z", 0)


def first_date(x: Column | str) -> Column:
    """The first date in a text, which is the text itself if that is a date; else ''."""
    return F.regexp_extract(strip(x), PARTS, 0)


def parts(found: Column) -> Column:
    """struct(y, m, d) of a date, null of ''."""
    split = lambda d: F.when(d != "", F.struct(F.substring(d, 1, 4).alias("y"), F.substring(d, 6, 2).alias("m"), F.substring(d, 9, 2).alias("d")))
    return let(found, split)


def parse_date(x: Column | str) -> Column:
    return parts(whole_date(x))


def find_date(x: Column | str) -> Column:
    return parts(first_date(x))


def year(x: Column | str) -> Column:
    return F.regexp_extract(col(x), r"^(\d{4})", 1).try_cast("int")
