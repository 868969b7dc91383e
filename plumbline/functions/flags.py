"""Row flags: encodings, roll-ups and bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def encoded_true(flag: Column) -> Column:
    """TRUE for a 0 / 1 column that stores FALSE / TRUE."""
    return flag.cast("int") == 1


def layer_count(*flags: Column) -> Column:
    """Number of flags that hold; a blank flag does not."""
    return reduce(add, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags])


def any_flag(*flags: Column) -> Column:
    return layer_count(*flags) > 0


def band(rate: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Label of the highest threshold that ``rate`` reaches."""
    out = None
    for threshold, label in sorted(steps, reverse=True):
        reached = rate >= F.lit(threshold)
        out = F.when(reached, label) if out is None else out.when(reached, label)
    out = out.when(rate.isNotNull(), lowest)
    return out
