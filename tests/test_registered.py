"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as contract
from checks import oracle, registry

from .conftest import DATA

TABLES = "documents embeddings benchmark labels conversations".split()
QUERIES, SQL = registry.QUERIES, oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        return round(value, 9) + 0.0 if isinstance(value, float) else value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    duck.execute(SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(df.columns)
    expected = canonical(duck.fetchall(), names)
    assert canonical(df.collect(), df.columns) == expected
    # at this scale every wanted id has a vector
    assert expected or name == "missing_ids"


def test_entry(spark):
    found = {r["measure"]: r["mean"] for r in contract.entry(spark).collect()}
    assert set(found) == {"nDCG@10", "AP", "R@100", "RR@10"} and all(0 < v <= 1 for v in found.values())
