import inspect

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    for fn in entry_point.queries().values():
        assert len(inspect.signature(fn).parameters) == 2


def test_flagship_returns_twenty_documents(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["doc_id", "score", "id", "title", "snippet", "position"]
    assert frame.count() == 20


@pytest.mark.parametrize(
    "name", ["model_local", "score_docs_all", "search_stored_index_top20", "one_vs_rest_tags", "tsv_rejects", "model_given_order", "active_learning_rounds"]
)
def test_queries_match_their_sql(spark, name):
    rows, wrong = differences(spark, connect(SF), SF, name)
    assert rows > 0 and not wrong

