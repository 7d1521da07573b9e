"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from benefactor.plans.catalog import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toArrow(), duck.execute(SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert [str(ours.schema.field(c).type) for c in columns] == [str(theirs.schema.field(c).type) for c in columns]

    def rows(table):
        return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns], strict=True)))

    assert rows(ours) == rows(theirs)


def test_expected_summary(spark):
    """Figures of an independent model, for the names that the derived tables write."""
    got = {r["funder"]: (r["total_pubs"], r["data_sharing_pubs"]) for r in QUERIES["funder_summary"](spark, DATA).collect()}
    assert got["National Science Foundation"][0] >= 9 and len(got) == 47
