"""Every query that has SQL gives the same rows in DuckDB."""

import math

import pytest

import __spark_entry__ as entry

from .conftest import DATA

SQL = {k: v for k, v in entry.oracle_sql().items() if entry.queries()[k].__module__.startswith("retrigauge.plans")}
FREE = [k for k, f in entry.queries().items() if k not in entry.oracle_sql() and f.__module__.startswith("retrigauge.plans")]


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", FREE)
def test_runs(spark, name):
    assert entry.queries()[name](spark, str(DATA)).columns
    assert entry.queries()[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
