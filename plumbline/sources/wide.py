"""One wide table: a fact with its dimensions, identifiers left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.model import Model
from plumbline.plans.compose import joined_rows


def wide_table(model: Model, fact: str, fields: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    return joined_rows(model, fact, [f for f in fields if f not in set(exclude)])
