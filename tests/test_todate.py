"""Year to date of distinct counts and percentiles, against plain Python."""

import collections
import datetime
import random

import numpy as np
import pytest

from plumbline.operators import todate

ROWS = "team string, day date, value double"


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    days = [datetime.date(2019, 12, 20) + datetime.timedelta(k) for k in range(0, 120, 2)]
    return [
        (rnd.choice(("a", "a", "a", "b", None)), rnd.choice((*days, None)), rnd.choice((None, rnd.randrange(-50, 900) / 4, 7.0)))
        for _ in range(n)
    ]


def so_far(rows, grain):
    """{(team, period): values of the year up to the end of the period}."""
    first = {"day": lambda d: d, "month": lambda d: d.replace(day=1), "year": lambda d: d.replace(month=1, day=1)}[grain]
    held = collections.defaultdict(list)
    for team, day, value in rows:
        if day is not None:
            held[team, first(day)].append(value)
    return {
        (team, p): [v for (t, q), vs in held.items() if t == team and q.year == p.year and q <= p for v in vs]
        for team, p in held
    }


@pytest.mark.parametrize("grain", ["day", "month", "year"])
def test_distinct_to_date(spark, grain):
    rows = rows_of(1)
    frame = spark.createDataFrame(rows, ROWS).withColumnRenamed("team", "group")
    got = todate.distinct_to_date(frame, ["group"], "day", "value", "n", grain)
    assert {(r["group"], r["period"]): r["n"] for r in got.collect()} == {k: len(set(v)) for k, v in so_far(rows, grain).items()}


@pytest.mark.parametrize(("grain", "split"), [("day", 1_000_000), ("month", 20)])
def test_percentiles_to_date(spark, grain, split):
    rows = rows_of(2)
    points = {"low": 0.0, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = todate.percentiles_to_date(spark.createDataFrame(rows, ROWS), ["team"], "day", "value", points, grain, split)
    got = {(r["team"], r["period"]): [r[n] for n in points] for r in got.collect()}
    known = [r for r in rows if r[2] is not None]
    want = {k: np.quantile(v, list(points.values())).tolist() for k, v in so_far(known, grain).items()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == pytest.approx(values)


def test_without_groups_and_without_rows(spark):
    rows = rows_of(3, 30)
    got = todate.percentiles_to_date(spark.createDataFrame(rows, ROWS), [], "day", "value", {"median": 0.5}, "year")
    known = [(None, d, v) for _, d, v in rows if v is not None]
    assert {r["period"]: r["median"] for r in got.collect()} == {p: np.median(v) for (_, p), v in so_far(known, "year").items()}
    nothing = spark.createDataFrame([], ROWS)
    assert todate.percentiles_to_date(nothing, ["team"], "day", "value", {"median": 0.5}).count() == 0
    assert todate.distinct_to_date(nothing, ["team"], "day", "value", "n").count() == 0
    with pytest.raises(ValueError):
        todate.distinct_to_date(nothing, [], "day", "value", "n", "week")
