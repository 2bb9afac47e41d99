"""Every query beside its DuckDB SQL."""

import math

import pytest

from ledgerloom.queries import ORACLES, QUERIES
from tests.conftest import SF_TINY, tables


def plain(names, rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "int": "INTEGER"}


@pytest.fixture(scope="module")
def db():
    return tables(SF_TINY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_says_what_sql_says(spark, db, name):
    got = QUERIES[name](spark, SF_TINY)
    want = db.sql(ORACLES[name])
    assert {c: TYPES.get(t) for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_agrees_with_itself(spark, name):
    first, again = (QUERIES[name](spark, SF_TINY) for _ in range(2))
    rows = first.collect()
    assert rows and plain(first.columns, rows) == plain(again.columns, again.collect())
