import pytest

from ledgerloom.plans import pages

from .conftest import SF_TINY, tables


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """A folder with customers whose balances are zeros of both signs, cents of both signs and others."""
    d, db = tmp_path_factory.mktemp("edges"), tables(SF_TINY)
    balance = "CASE c_custkey WHEN 3 THEN -0.0::DOUBLE WHEN 4 THEN 0.0 WHEN 5 THEN -0.01 WHEN 6 THEN 0.01 WHEN 7 THEN -999.99 WHEN 8 THEN 9999.99 ELSE c_acctbal END"
    db.execute(f"COPY (SELECT * REPLACE ({balance} AS c_acctbal) FROM customer WHERE c_custkey < 40) TO '{d}/customer.parquet' (FORMAT parquet)")
    db.execute(f"COPY orders TO '{d}/orders.parquet' (FORMAT parquet)")
    return str(d)


def said(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)  # as text, negative zero isn't zero


@pytest.mark.parametrize("name", ["filing_blocks", "filing_cells", "filing_facts"])
def test_zeros_of_both_signs(spark, edges, name):
    import duckdb

    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{edges}/{t}.parquet'")
    got = pages.QUERIES[name](spark, edges)
    own = ", ".join(f'"{c}"' for c in got.columns)
    assert said(got.collect()) == said(db.execute(f"SELECT {own} FROM ({pages.ORACLES[name]})").fetchall())


def test_chunk_numbers_are_not_broadcast(spark, edges):
    plan = pages.filing_chunks(spark, edges)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
