"""Name matching in strict steps, and lookups in a rules table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.names import identifier_form
from plumbline.operators.attach import attach


def _hits(targets: DataFrame, key) -> DataFrame:
    """Targets per key, with the only id where there is just one. A target
    without a key is no target: blank names match nothing."""
    return targets.where(key.isNotNull()).groupBy(key.alias("__key")).agg(
        F.count("*").alias("__hits"), F.min("target_id").alias("__target")
    )


def match_cascade(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Map ``sources(source_id, name)`` to ``targets(target_id, name, declared)``.

    Steps: declared source name, same name in any case, same identifier form.
    A step with several hits is ambiguous and ends the search; an identifier
    form shared by several sources is ambiguous too. Nothing is matched fuzzily.
    """
    lowered = F.lower("name")
    form = F.nullif(identifier_form(F.col("name")), F.lit(""))
    steps = (
        ("explicit", lowered, targets.where("declared is not null"), F.lower("declared")),
        ("exact", lowered, targets, lowered),
        ("form", form, targets, form),
    )
    frame = sources
    for step, source_key, pool, target_key in steps:
        found = _hits(pool, target_key).select(
            F.col("__key").alias(f"__{step}"),
            F.col("__hits").alias(f"{step}_hits"),
            F.col("__target").alias(f"{step}_target"),
        )
        frame = attach(frame.withColumn(f"__{step}", source_key), found, [f"__{step}"])
    clashes = sources.groupBy(form.alias("__form")).agg(F.count("*").alias("form_sources"))
    frame = attach(frame, clashes, ["__form"])

    hits = {s: F.coalesce(f"{s}_hits", F.lit(0)) for s in ("explicit", "exact", "form")}
    unique_form = (F.col("form_sources") == 1) | F.col("__form").isNull()
    ambiguous = F.lit("AMBIGUOUS")
    method = (
        F.when(hits["explicit"] == 1, "EXPLICIT_MAPPING")
        .when(hits["explicit"] > 1, ambiguous)
        .when(hits["exact"] == 1, "EXACT_NAME")
        .when(hits["exact"] > 1, ambiguous)
        .when(~unique_form, ambiguous)
        .when(hits["form"] == 1, "UNIQUE_IDENTIFIER_NORMALIZATION")
        .when(hits["form"] > 1, ambiguous)
        .otherwise("NO_MATCH")
    )
    reason = (
        F.when(hits["explicit"] == 1, None)
        .when(hits["explicit"] > 1, "DUPLICATE_EXPLICIT_TARGET")
        .when(hits["exact"] == 1, None)
        .when(hits["exact"] > 1, "DUPLICATE_EXACT_TARGET")
        .when(~unique_form, "SOURCE_NORMALIZATION_COLLISION")
        .when(hits["form"] > 1, "TARGET_NORMALIZATION_COLLISION")
    )
    target = (
        F.when(F.col("method") == "EXPLICIT_MAPPING", F.col("explicit_target"))
        .when(F.col("method") == "EXACT_NAME", F.col("exact_target"))
        .when(F.col("method") == "UNIQUE_IDENTIFIER_NORMALIZATION", F.col("form_target"))
    )
    return (
        frame.withColumn("method", method)
        .withColumn("reason", reason)
        .withColumn("target_id", target)
        .select("source_id", "name", "target_id", "method", "reason")
    )


def signature_lookup(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Find the one rule with exactly the item's ``signature``; none or several
    send the item to manual review.

    Only rules count whose ``status`` is ACCEPTED and ``supersession_status``
    CURRENT, where rules have these columns. An item whose ``supplied``
    signature, where items have it, is not its own is not looked up at all.
    """
    eligible = F.col("signature").isNotNull()
    for column, needed in (("status", "ACCEPTED"), ("supersession_status", "CURRENT")):
        if column in rules.columns:
            eligible = eligible & (F.col(column) == needed)
    known = rules.where(eligible).groupBy("signature").agg(
        F.count("*").alias("__hits"), F.min("rule_id").alias("__rule")
    )
    exact = F.lit(True)
    if "supplied" in items.columns:
        exact = F.col("supplied").eqNullSafe(F.col("signature"))
    hits = F.coalesce("__hits", F.lit(0))
    return (
        attach(items, known, ["signature"])
        .withColumn(
            "outcome",
            F.when(~exact, "REVIEW_SIGNATURE_NOT_EXACT")
            .when(hits == 0, "NO_EXACT_REVIEW_RULE")
            .when(hits > 1, "AMBIGUOUS_REVIEW_RULE")
            .otherwise("REVIEW_RULE_SUGGESTED"),
        )
        .withColumn("rule_id", F.when(exact & (hits == 1), F.col("__rule")))
        .drop("__hits", "__rule")
    )
