"""Row derivations, names, formats and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import query
from plumbline.functions import durations, flags, formats, names
from plumbline.functions.blanks import strict_add
from plumbline.queries.registry import case, rounded
from plumbline.sources import evidence
from plumbline.sources.tables import read_table
from plumbline.star import derive_results, star


@case(
    "duration_parse",
    """WITH t AS (SELECT event_id, CASE event_type
        WHEN 'click' THEN strftime(ts, '%H:%M:%S') WHEN 'view' THEN strftime(ts, ' %M:%S ')
        WHEN 'error' THEN strftime(ts, '%H:7%M:%S') WHEN 'signup' THEN event_type
        ELSE strftime(ts, '%-d:%M:%S') END AS text FROM events),
    p AS (SELECT event_id, text, string_split(trim(text), ':') AS b FROM t)
    SELECT event_id, CASE WHEN regexp_full_match(trim(text), '([0-9]{1,4}:)?[0-5]?[0-9]:[0-5][0-9]') THEN
      CASE WHEN len(b) = 3 THEN b[1]::INT * 3600 + b[2]::INT * 60 + b[3]::INT
        ELSE b[1]::INT * 60 + b[2]::INT END END AS seconds FROM p""",
)
def duration_parse(spark, path):
    ts, kind = F.col("ts"), F.col("event_type")
    text = (
        F.when(kind == "click", F.date_format(ts, "HH:mm:ss"))
        .when(kind == "view", F.date_format(ts, " mm:ss "))
        .when(kind == "error", F.date_format(ts, "HH:'7'mm:ss"))
        .when(kind == "signup", kind)
        .otherwise(F.date_format(ts, "d:mm:ss"))
    )
    events = read_table(spark, path, "events")
    return events.select("event_id", durations.to_seconds(text).alias("seconds"))


@case(
    "null_strict_sum",
    """WITH $RESULTS SELECT o_orderkey, part_a + part_b + part_c AS abc, part_d + part_e AS transition,
    part_a + part_b + part_c + part_d + part_e AS parts FROM o""",
)
def null_strict_sum(spark, path):
    parts = [F.col(f"part_{p}") for p in "abcde"]
    return derive_results(read_table(spark, path, "orders")).select(
        "o_orderkey",
        strict_add(*parts[:3]).alias("abc"),
        strict_add(*parts[3:]).alias("transition"),
        strict_add(*parts).alias("parts"),
    )


@case(
    "reconcile_delta_rows",
    """WITH $RESULTS SELECT o_orderkey,
    CAST(floor(o_totalprice) AS BIGINT) - (part_a + part_b + part_c + part_d + part_e) AS delta,
    abs(CAST(floor(o_totalprice) AS BIGINT) - (part_a + part_b + part_c + part_d + part_e)) AS abs_delta
    FROM o""",
)
def reconcile_delta_rows(spark, path):
    parts = strict_add(*(F.col(f"part_{p}") for p in "abcde"))
    delta = F.floor("o_totalprice") - parts
    return derive_results(read_table(spark, path, "orders")).select(
        "o_orderkey", delta.alias("delta"), F.abs(delta).alias("abs_delta")
    )


@case(
    "validity_flags",
    """WITH $RESULTS SELECT o_orderkey, part_b IS NOT NULL AS has_b, part_d IS NOT NULL AS has_d,
    part_a IS NOT NULL AND part_b IS NOT NULL AND part_c IS NOT NULL AS has_complete,
    coalesce(closed_status IN ('F', 'O'), false) AS has_status, o_orderstatus = 'F' AS is_finisher,
    o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND part_b IS NOT NULL AS is_valid_abc
    FROM o""",
)
def validity_flags(spark, path):
    known = [F.col(f"part_{p}").isNotNull() for p in "abc"]
    finisher = F.col("o_orderstatus") == "F"
    complete = known[0] & known[1] & known[2]
    return derive_results(read_table(spark, path, "orders")).select(
        "o_orderkey",
        known[1].alias("has_b"),
        F.col("part_d").isNotNull().alias("has_d"),
        complete.alias("has_complete"),
        F.coalesce(F.col("closed_status").isin("F", "O"), F.lit(False)).alias("has_status"),
        finisher.alias("is_finisher"),
        (finisher & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & complete).alias("is_valid_abc"),
    )


@case(
    "flag_layers",
    """WITH $RESULTS SELECT o_orderkey,
    is_closed::INT + is_valid::INT + is_review + coalesce((part_b > 100000)::INT, 0) AS flag_layer_count,
    is_closed::INT + is_valid::INT + is_review + coalesce((part_b > 100000)::INT, 0) > 0 AS any_flag FROM o""",
)
def flag_layers(spark, path):
    layers = [
        F.col("is_closed"),
        F.col("is_valid"),
        flags.encoded_true(F.col("is_review")),
        F.col("part_b") > 100000,
    ]
    return derive_results(read_table(spark, path, "orders")).select(
        "o_orderkey",
        flags.layer_count(*layers).alias("flag_layer_count"),
        flags.any_flag(*layers).alias("any_flag"),
    )


@case(
    "format_display",
    """WITH $GEO SELECT n_name, count(*)::VARCHAR AS result_rows,
    format('{:,.2f}', avg(part_b)) AS b_average,
    format('{:.1f}', 100 * count(*) FILTER (WHERE is_valid)::DOUBLE / count(*)) || '%' AS valid_rate
    FROM g GROUP BY 1""",
)
def format_display(spark, path):
    frame = query(star(spark, path), ["result_rows", "b_average", "valid_rate"], by=["nation.n_name"])
    shown = {"result_rows": "whole_number", "b_average": "decimal_2", "valid_rate": "percentage_1_decimal"}
    return frame.select(
        "n_name", *(formats.display(F.col(c), f).alias(c) for c, f in shown.items())
    )


@case(
    "name_normalise",
    """SELECT page_id, upper(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS identifier,
    regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS compact FROM pages""",
)
def name_normalise(spark, path):
    return read_table(spark, path, "pages").select(
        "page_id",
        names.identifier_form(F.col("url")).alias("identifier"),
        names.compact_form(F.col("url")).alias("compact"),
    )


@case(
    "stable_ids",
    """SELECT o_orderkey, 'fnd_' || substr(sha256('["' || o_orderpriority || '",' || o_orderkey || ','
      || coalesce('"' || nullif(o_orderstatus, 'P') || '"', 'null') || ']' || chr(10)), 1, 16) AS finding_id
    FROM orders""",
)
def stable_ids(spark, path):
    parts = [F.col("o_orderpriority"), F.col("o_orderkey"), F.nullif("o_orderstatus", F.lit("P"))]
    orders = read_table(spark, path, "orders")
    return orders.select("o_orderkey", names.stable_id("fnd_", *parts).alias("finding_id"))


@case(
    "evidence_explode",
    """WITH e AS (SELECT event_type AS source_measure, event_id, regexp_extract(props, '[0-9]+') AS k,
      CAST(floor(value) AS BIGINT) AS v FROM events)
    SELECT source_measure, 'EVENT' AS slice, 'INTEGER' AS value_type, side,
      CASE part WHEN 1 THEN '{"EVENT.ID":' || event_id || ',"EVENT.K":' || k || '}'
        ELSE '{"EVENT.ID":"' || event_id || '"}' END AS coordinates,
      CASE WHEN side = 'target' AND part = 2 THEN NULL ELSE v::VARCHAR END AS value
    FROM e, (VALUES ('source', 1), ('source', 2), ('target', 1), ('target', 2)) AS x(side, part)
    WHERE side = 'source' OR source_measure <> 'error'""",
)
def evidence_explode(spark, path):
    return evidence.evidence_rows(evidence.read_evidence(_documents(spark, path), "document"))


def _documents(spark, path):
    """One evidence document per event, its target missing for errors.

    Keys are written out of order to show that coordinates come back sorted.
    """
    text = """
        concat('{"source_measure":"', event_type, '","slice":"EVENT","value_type":"integer","source":',
          '{"status":"AVAILABLE","complete":true,"result_sha256":null,"rows":[{"coordinates":{"EVENT.K":', k,
          ',"EVENT.ID":', event_id, '},"value":', v, '},{"coordinates":{"EVENT.ID":"', event_id,
          '"},"value":', v, '}]},"target":',
          if(event_type = 'error',
            '{"status":"NOT_AVAILABLE","complete":false,"result_sha256":null,"rows":[]}',
            concat('{"status":"AVAILABLE","complete":true,"result_sha256":null,"rows":[{"value":', v,
              ',"coordinates":{"EVENT.ID":', event_id, ',"EVENT.K":', k,
              '}},{"coordinates":{"EVENT.ID":"', event_id, '"},"value":null}]}')),
          '}')"""
    events = read_table(spark, path, "events").select(
        "event_type",
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.floor("value").alias("v"),
    )
    return events.select(F.expr(text).alias("document"))


@case(
    "evidence_compare",
    """SELECT event_type AS source_measure, CASE WHEN event_type <> 'error' THEN count(*) END AS mismatches,
    CASE WHEN event_type = 'error' THEN 'NOT_AVAILABLE' ELSE 'FAILED' END AS status, 'EVENT' AS slice
    FROM events GROUP BY 1""",
)
def evidence_compare(spark, path):
    from plumbline.operators import reconcile

    endpoints = evidence.read_evidence(_documents(spark, path), "document")
    return reconcile.evidence_status(endpoints, reconcile.compare_evidence(endpoints))


@case(
    "evidence_gate",
    """WITH e AS (SELECT event_type AS source_measure, event_id::VARCHAR AS slice, event_id % 8 AS k FROM events)
    SELECT source_measure, slice, CASE k WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN 1 END AS mismatches,
      CASE k WHEN 3 THEN 'DUPLICATE' WHEN 4 THEN 'TYPE' WHEN 5 THEN 'HASH' WHEN 6 THEN 'ROW' WHEN 7 THEN 'LABEL' ELSE '' END AS faults,
      CASE k WHEN 0 THEN 'PASSED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'NOT_AVAILABLE' ELSE 'REFUSED' END AS status
    FROM e""",
)
def evidence_gate(spark, path):
    """One record per event: right, differing, absent, or with one of the faults that have it refused."""
    from plumbline.operators import reconcile

    events = read_table(spark, path, "events").select(
        "event_type", "event_id", (F.col("event_id") % 8).alias("k"), F.floor("value").cast("string").alias("v")
    )
    row = lambda value: F.concat(F.lit('{"coordinates":{"EVENT.ID":'), F.col("event_id").cast("string"), F.lit('},"value":'), value, F.lit("}"))
    v, quoted = F.col("v"), F.concat(F.lit('"'), F.col("v"), F.lit('"'))
    more = F.floor(F.col("v").cast("double") + 1).cast("string")
    source = F.when(F.col("k") == 3, F.concat(row(v), F.lit(","), row(v))).otherwise(row(v))
    target = F.when(F.col("k") == 1, row(more)).when(F.col("k") == 4, row(F.concat("v", F.lit(".0")))).when(F.col("k") == 6, row(quoted))
    label = F.when(F.col("k") == 7, "MONEY").otherwise("INTEGER")
    document = F.concat(
        F.lit('{"source_measure":"'), F.col("event_type"), F.lit('","slice":"'), F.col("event_id").cast("string"), F.lit('","value_type":"'), label,
        F.lit('","source":'), _available(source, F.lit("")),
        F.lit(',"target":'),
        F.when(F.col("k") == 2, '{"status":"NOT_AVAILABLE","complete":false,"result_sha256":null,"rows":[]}').otherwise(
            _available(target.otherwise(row(v)), F.when(F.col("k") == 5, " ").otherwise(""))
        ),
        F.lit("}"),
    )
    return reconcile.gated_evidence(evidence.read_evidence(events.select(document.alias("document")), "document"))


def _available(rows, spoiled):
    """An endpoint with the hash of its canonical form, or of another text."""
    rows = F.concat(F.lit("["), rows, F.lit("]"))
    canonical = F.concat(F.lit('{"complete":true,"rows":'), rows, F.lit(',"status":"AVAILABLE"}\n'), spoiled)
    return F.concat(F.lit('{"status":"AVAILABLE","complete":true,"result_sha256":"'), F.sha2(canonical, 256), F.lit('","rows":'), rows, F.lit("}"))


@case(
    "metric_slices_long",
    """WITH $GEO, a AS (
      SELECT 'OVERALL' AS slice, 0 AS grouping, '{}' AS coordinates, count(*) AS n,
        count(*) FILTER (WHERE is_valid) AS v, sum(part_b) AS b FROM g
      UNION ALL SELECT 'STATUS', 0, '{"orders.o_orderstatus":"' || o_orderstatus || '"}', count(*),
        count(*) FILTER (WHERE is_valid), sum(part_b) FROM g GROUP BY o_orderstatus
      UNION ALL SELECT 'COUNTRY', 0, '{"nation.n_name":"' || n_name || '","region.r_name":"' || r_name || '"}', count(*),
        count(*) FILTER (WHERE is_valid), sum(part_b) FROM g GROUP BY n_name, r_name
      UNION ALL SELECT 'COUNTRY', 1, '{"region.r_name":"' || r_name || '"}', count(*),
        count(*) FILTER (WHERE is_valid), sum(part_b) FROM g GROUP BY r_name
      UNION ALL SELECT 'COUNTRY', 2, '{}', count(*), count(*) FILTER (WHERE is_valid), sum(part_b) FROM g)
    SELECT slice, "grouping", coordinates, 'result_rows' AS metric, n::DOUBLE AS value, CAST(n AS DECIMAL(38,0)) AS whole FROM a
    UNION ALL SELECT slice, "grouping", coordinates, 'valid_rate', round(v::DOUBLE / n, 6), NULL FROM a
    UNION ALL SELECT slice, "grouping", coordinates, 'b_total', b::DOUBLE, CAST(b AS DECIMAL(38,0)) FROM a WHERE slice <> 'STATUS'""",
)
def metric_slices_long(spark, path):
    from plumbline import metric_slices

    every = tuple(SLICES)
    required = {
        "result_rows": every,
        "valid_rate": every,
        "b_total": ("OVERALL", "COUNTRY"),
    }
    return rounded(metric_slices(star(spark, path), list(required), SLICES, required))


SLICES = {
    "OVERALL": [()],
    "STATUS": [("orders.o_orderstatus",)],
    "COUNTRY": [("region.r_name", "nation.n_name"), ("region.r_name",), ()],
}
