"""Arithmetic with blanks (SQL NULL)."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, functions as F


def blank_add(*parts: Column) -> Column:
    """Sum where a blank counts as zero, unless every part is blank."""
    everything_blank = reduce(and_, [p.isNull() for p in parts])
    return F.when(~everything_blank, reduce(add, [F.coalesce(p, F.lit(0)) for p in parts]))


def strict_add(*parts: Column) -> Column:
    """Sum that is blank as soon as one part is."""
    return reduce(add, parts)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, blank when the denominator is blank or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def distinct_with_blank(value: Column, visible: Column | None = None) -> Column:
    """Distinct values of the visible rows, a blank being one more value."""
    if visible is None:
        seen, blank = value, value.isNull()
    else:
        seen, blank = F.when(visible, value), visible & value.isNull()
    return F.count_distinct(seen) + F.coalesce(F.max(blank.cast("int")), F.lit(0))
