"""Display formats of metric values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_number(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value, 0), ",", "")


def two_decimals(value: Column) -> Column:
    return F.format_number(value, 2)


def percent_one_decimal(value: Column) -> Column:
    return F.concat(F.regexp_replace(F.format_number(value * 100, 1), ",", ""), F.lit("%"))


# Fixed names of the display formats.
FORMATS = {
    "whole_number": whole_number,
    "decimal_2": two_decimals,
    "percentage_1_decimal": percent_one_decimal,
}


def display(value: Column, name: str) -> Column:
    return FORMATS[name](value)
