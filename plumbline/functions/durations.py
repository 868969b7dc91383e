"""Duration text to seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed rule: H:MM:SS or MM:SS, minutes and seconds below 60.
PATTERN = r"^(?:(\d+):)?([0-5]?\d):([0-5]\d)$"


def to_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``MM:SS`` text; anything else is blank, and so
    is a duration whose seconds do not fit into 64 bits."""
    clean = F.btrim(text)
    hours, minutes, seconds = (F.regexp_extract(clean, PATTERN, i) for i in (1, 2, 3))
    whole = F.when(hours == "", F.lit(0).cast("bigint")).otherwise(hours.try_cast("bigint"))
    rest = minutes.try_cast("bigint") * 60 + seconds.try_cast("bigint")
    total = F.try_add(F.try_multiply(whole, F.lit(3600).cast("bigint")), rest)
    return F.when(clean.rlike(PATTERN), total)
