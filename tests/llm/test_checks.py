"""The registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from reviewlens.llm.queries import CHECKS, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels")


def rows_of(spark, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(CHECKS[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(
        con.sql(f"select {listed} from ({CHECKS[name]})").fetchall(), key=repr
    )


@pytest.mark.parametrize("name", sorted(CHECKS))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_same_as_sql(spark, name, folder):
    got, want = rows_of(spark, folder, name)
    assert len(got) == len(want) > 0
    assert got == want
