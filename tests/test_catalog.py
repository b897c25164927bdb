"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from tidemark import catalog


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, tiny, oracle, name):
    got = catalog.queries()[name](spark, tiny)
    want = oracle.execute(catalog.oracle_sql()[name]).to_arrow_table()
    have = got.toArrow()
    columns = sorted(have.column_names)
    assert columns == sorted(want.column_names)
    assert [str(have.schema.field(c).type) for c in columns] == [str(want.schema.field(c).type) for c in columns]
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns), strict=True)))
    assert rows(have) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql()) and set(catalog.queries()) <= set(__spark_entry__.queries())
