"""The numbered queries with SQL against DuckDB on the smallest tables; all of them on empty tables."""

import os

import pytest

from overlay_jobs.llm import queries as Q
from tests.test_oracles import SF, same_as_sql


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    same_as_sql(spark, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert Q.queries()[name](spark, str(tmp_path)).count() == 0
