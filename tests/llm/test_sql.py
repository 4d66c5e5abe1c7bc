import duckdb
import pytest

from rotorlake.llm import queries


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert values([tuple(r) for r in df.collect()], df.columns) == values(want.fetchall(), want.columns)
