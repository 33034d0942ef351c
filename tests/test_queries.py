"""Every registered query of the base package against its SQL in DuckDB."""

import duckdb
import pytest

from ravenna.plans import oracle, queries

TABLES = ("documents", "benchmark", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    show = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(show(r[k]) for k in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    got = df.collect()
    ran = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, ran.fetchall())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = queries.doc_hashes(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    ranked = queries.bm25_topn(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked


def test_entry_point(spark):
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
