"""Keys that were written as text: numbers with blanks, leading zeros or a decimal point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_key(column: Column | str) -> Column:
    """A key as a long. '7', ' 07', '7.0' are 7; null, blank and anything that is no whole number is null.

    Digits are ASCII. A key above the range of a long is null.
    """
    text = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]{1,19}(\.0*)?$"), F.regexp_extract(text, r"^\+?(-?[0-9]+)", 1).try_cast("bigint"))


def period(column: Column | str) -> Column:
    """The month of a timestamp as YYYY-MM; null stays null."""
    return F.date_format(column, "yyyy-MM")
