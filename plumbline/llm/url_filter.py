"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

A URL that no rule decides is blocked if its canonical form is listed. The filter, sent to every worker, lets
possible hits through; only those are joined exactly with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocked_bloom import build_bloom

#: Query parameters that do not change a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without `index.html` and a last slash, other parameters in order.

    Null where there is no host: scheme, fragment, tracking parameters and parameter order make no difference.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id: str = "page_id", url: str = "url", listed_url: str = "url"
) -> DataFrame:
    """One row for each row: id, host, path, rule and verdict.

    `listed` holds URLs in any form, repeats and nulls included; an empty list blocks nothing. A null URL, or one
    without `://`, has an empty host and path, fits no rule and is allowed. Repeated rows give a row each; other
    columns are not read; an empty table gives an empty result.
    """
    wanted = listed.select(canonical(F.col(listed_url)).alias("listed")).where("listed is not null").distinct()
    bloom = pages.sparkSession.sparkContext.broadcast(build_bloom(wanted.select(F.xxhash64("listed"))))

    @F.pandas_udf("boolean")
    def might_be_listed(key: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.might_hold(key.to_numpy()))

    rows = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    asked = F.col("verdict").isNull() & F.col("key").isNotNull()
    rows = rows.withColumn("hash", F.xxhash64("key")).withColumn("maybe", might_be_listed("hash") & asked)
    checked = rows.where("maybe").join(wanted, F.col("key") == F.col("listed"), "left")
    checked = checked.withColumn("verdict", F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    others = rows.where("not maybe").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    columns = [F.col("id").alias(id), "host", "path", "rule", "verdict"]
    return checked.select(columns).unionByName(others.select(columns))
