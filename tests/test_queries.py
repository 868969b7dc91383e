"""Every registered query against its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from plumbline.queries import CASES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return repr(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=repr)


def compare(spark, sql, sf, name):
    case = CASES[name]
    frame = case.run(spark, sf)
    got = table([tuple(r) for r in frame.collect()], frame.columns)
    cursor = sql.execute(case.sql)
    columns = [d[0] for d in cursor.description]
    want = table(cursor.fetchall(), columns)
    assert sorted(frame.columns) == sorted(columns)
    assert len(got) == len(want)
    for mine, theirs in zip(got, want):
        assert mine == theirs
    return len(got)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_matches_sql(spark, sql, sf, name):
    assert CASES[name].sql is not None
    compare(spark, sql, sf, name)
