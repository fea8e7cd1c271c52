import os

import pytest

from cinderlake.llm import queries

from ..against_sql import TABLES, same_rows


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_query_gives_a_row_per_document(spark, name):
    rows = queries.queries()[name](spark, TABLES)
    table = {"op4_chat": "conversations", "op7_url_filter": "pages"}.get(name, "documents")
    key = {"conversations": "conv_id", "pages": "page_id"}.get(table, "doc_id")
    want = spark.read.parquet(f"{TABLES}/{table}.parquet").select(key).distinct().count() + (name == "op4_chat")
    assert rows.select(key).distinct().count() == want
