"""Queries of the training-data operators against their SQL."""

import pytest

from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    flat = lambda row: tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in row)
    want = sorted(map(flat, con.fetchall()), key=repr)
    assert sorted(map(flat, queries.queries()[name](spark, sf_dir).select(columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_the_columns_of_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = [r[0] for r in con.execute(f"DESCRIBE {queries.oracle_sql()[name]}").fetchall()]
    assert queries.queries()[name](spark, sf_dir).columns == want


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")}
    assert numbers == set(range(1, 11))
