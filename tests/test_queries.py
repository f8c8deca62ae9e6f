"""Every registered query with a DuckDB twin gives the twin's rows."""

import duckdb
import pytest

from lathe.plans.catalogue import ORACLES, QUERIES
from lathe.session import ship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def rows(table, names):
    return sorted(map(repr, table.select(names).to_pylist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, twin, name):
    ship(spark)
    got, want = QUERIES[name](spark, SF).toArrow(), twin.sql(ORACLES[name]).to_arrow_table()
    names = sorted(got.schema.names)
    assert names == sorted(want.schema.names)
    assert rows(got, names) == rows(want, names)


def test_all_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
