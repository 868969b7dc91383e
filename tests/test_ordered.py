"""Order statistics against plain Python, with and without range splitting."""

import math
import random
from collections import defaultdict

import pytest

from plumbline.operators import ordered


def make_rows(seed=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        # One key holds a third of the rows, one key is blank.
        key = rng.choice(["hot", "hot", "hot", "a", "b", "c", None, "d", "e"])
        kind = rng.random()
        value = None if kind < 0.05 else 1e300 if kind < 0.06 else round(rng.gauss(0, 50), 1)
        if key == "e":
            value = None
        rows.append((key, value))
    rows.append(("one", 5.0))
    return rows


def grouped(rows):
    out = defaultdict(list)
    for key, value in rows:
        if value is not None:
            out[key].append(value)
    return {k: sorted(v) for k, v in out.items()}


def inclusive(values, p):
    spot = (len(values) - 1) * p
    low, high = math.floor(spot), math.ceil(spot)
    return values[low] + (values[high] - values[low]) * (spot - low)


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(4)


@pytest.mark.parametrize("split_above", [10, 1_000_000])
def test_counts(frame, rows, split_above):
    got = ordered.ordered_counts(frame, ["k"], "v", split_above).collect()
    want = {}
    for key, values in grouped(rows).items():
        for value in set(values):
            want[key, value] = (values.count(value), sum(v < value for v in values), len(values))
    assert {(r.k, r.v): (r.n, r.before, r.total) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("split_above", [10, 1_000_000])
def test_counts_without_keys(frame, rows, split_above):
    got = ordered.ordered_counts(frame, [], "v", split_above).collect()
    values = sorted(v for _, v in rows if v is not None)
    assert {r.v: (r.n, r.before, r.total) for r in got} == {
        v: (values.count(v), sum(w < v for w in values), len(values)) for v in set(values)
    }


@pytest.mark.parametrize("split_above", [10, 1_000_000])
def test_percentiles(frame, rows, split_above):
    got = ordered.percentiles(frame, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}, split_above)
    want = grouped(rows)
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(want)
    for key, values in want.items():
        for name, p in (("p0", 0), ("p50", 0.5), ("p90", 0.9), ("p100", 1)):
            assert found[key][name] == pytest.approx(inclusive(values, p), rel=1e-12)


def test_percentile_of_nothing_is_one_blank_row(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert [r.p for r in ordered.percentiles(empty, [], "v", {"p": 0.5}).collect()] == [None]
    assert ordered.percentiles(empty, ["k"], "v", {"p": 0.5}).collect() == []


def test_published_example(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert ordered.percentiles(frame, [], "v", {"p": 0.9}).first().p == pytest.approx(3.6)


@pytest.mark.parametrize("split_above", [10, 1_000_000])
def test_dense_rank(frame, rows, split_above):
    got = ordered.dense_rank(frame, ["k"], "v", "r", split_above=split_above).collect()
    assert len(got) == len(rows)
    places = {k: sorted(set(v), reverse=True) for k, v in grouped(rows).items()}
    for row in got:
        assert row.r == (None if row.v is None else places[row.k].index(row.v) + 1)


@pytest.mark.parametrize("split_above", [10, 1_000_000])
def test_relative_positions(frame, rows, split_above):
    got = ordered.relative_positions(frame, ["k"], {"v": "rel"}, split_above).collect()
    assert len(got) == len(rows)
    values = grouped(rows)
    for row in got:
        if row.v is None:
            assert row.rel is None
        elif len(values[row.k]) == 1:
            assert row.rel == 0
        else:
            larger = sum(v > row.v for v in values[row.k])
            assert row.rel == pytest.approx(larger / (len(values[row.k]) - 1))
