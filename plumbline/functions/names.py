"""Names and identifiers that are stable across runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def identifier_form(name: Column) -> Column:
    """Upper case, every run of other characters one underscore, trimmed."""
    return F.upper(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def compact_form(name: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def _canonical(value: Column) -> Column:
    """JSON of one value: blank as null, numbers bare, text quoted."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    # '{"v":' in front and '}' behind.
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def parts_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array, in full: what tells things apart."""
    array = F.concat(F.lit("["), F.concat_ws(",", *(_canonical(p) for p in parts)), F.lit("]\n"))
    return F.sha2(array, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix plus 16 hex digits of the parts' hash, for display."""
    return F.concat(F.lit(prefix), F.substring(parts_hash(*parts), 1, 16))


def sorted_json(entries: dict[str, Column]) -> Column:
    """JSON object with its keys in order and blanks kept."""
    fields = [entries[k].alias(k) for k in sorted(entries)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def signature(entries: dict[str, Column]) -> Column:
    """SHA-256 of the sorted JSON object."""
    return F.sha2(F.concat(sorted_json(entries), F.lit("\n")), 256)
