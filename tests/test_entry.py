"""The driver contract at the smallest scale."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["key", "model", "rmse"]
    assert df.count() > 0


def test_every_query_has_sql():
    from workload.queries import QUERIES

    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [
    "read_observations", "index_series", "assemble_by_var", "mine_all_rules", "score_models",
    "report_slice_mean", "evaluate_population", "next_generation",
])
def test_matches_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    want = check.connect(SF).execute(oracle_sql()[name]).df()
    assert check.difference(got, want) is None
