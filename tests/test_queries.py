"""Every registered query of the core library against its DuckDB SQL."""

import decimal
from pathlib import Path

import duckdb
import pytest

from veilgraph.plans import features, measures  # noqa: F401  register their queries
from veilgraph.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 5)
    return value


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{small}/{name}.parquet").exists():
            connection.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, small, duck, name):
    frame = q.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    found = sorted((tuple(_plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    answer = duck.sql(q.ORACLES[name])
    assert sorted(answer.columns) == columns
    place = [answer.columns.index(c) for c in columns]
    assert found == sorted((tuple(_plain(row[i]) for i in place) for row in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, small, name):
    assert q.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
