"""Every core query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from sediment.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return str(x)
    return round(float(x), 9) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLE_SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([d[0] for d in want.description], want.fetchall())


def test_verified_archive_and_two_passes(spark):
    checks = QUERIES["verify_archive"](spark, DIR).collect()
    assert len(checks) == 5 and all(r.ok for r in checks)
    assert {r.stage for r in QUERIES["two_pass_analysis"](spark, DIR).collect()} == {"probe", "controlled"}


def test_entry_lists_queries_with_or_without_the_training_data_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
