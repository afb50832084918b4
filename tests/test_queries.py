"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexigraf import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return c


def rows(names, values, columns):
    at = [names.index(c) for c in columns]
    return sorted(repr([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in at]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    columns = sorted(names)
    assert rows(got.columns, got.collect(), columns) == rows(names, cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
