"""Every registered query that has SQL gives the same rows in DuckDB, on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from overlay_jobs.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def same_as_sql(spark, query, sql):
    df = query(spark, SF)
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        out = con.sql(sql)
        names, want = out.columns, out.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    same_as_sql(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_layer_and_entry(spark):
    assert catalog.queries()["build_interactions"](spark, SF).count() > 0
    assert entry_module.entry(spark).count() > 0
