"""The series store, and conditions on the order of a series."""

import random

import pytest
from pyspark.sql import functions as F
from test_series import WHOLE, rows, skewed

from rulecast.operators import predicates as pr
from rulecast.operators import series as se
from rulecast.operators.layout import SeriesLayout
from rulecast.sources import store


def test_store_reads_one_series(spark, tmp_path):
    series = se.index_series(skewed(spark), WHOLE)
    path = str(tmp_path / "series")
    store.write_series(series, path, buckets=5)
    opened = store.open_series(spark, path)
    assert rows(opened.select(*series.columns)) == rows(series)
    for key in ("hot", "k3", "none"):
        one = store.stored_series(opened, key)
        assert one.columns == series.columns and rows(one) == rows(series.where(F.col("key") == key))
    found = store.stored_series(opened, "k3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k3)" in plan and "_bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert {f.split("_bucket=")[1][0] for f in found.inputFiles()} and rows(se.series_keys(opened)) == rows(se.series_keys(series))


def longest(values, hit):
    best = now = 0
    for j, v in enumerate(values):
        now = now + 1 if hit(values, j) else 0
        best = max(best, now)
    return best


@pytest.mark.parametrize("layout", [WHOLE, SeriesLayout(4), SeriesLayout(7), SeriesLayout(100)])
def test_runs_over_block_edges(spark, layout):
    draw = random.Random(4)
    data = {f"k{n}": [draw.choice([1.0, 2.0, 3.0, None]) if n % 2 else float(-j) for j in range(n * 3 + 1)] for n in range(12)}
    series = spark.createDataFrame([(k, j, x) for k, v in data.items() for j, x in enumerate(v)], "key string, i bigint, v0 double")

    def falls(v, j):
        return j > 0 and v[j] is not None and v[j - 1] is not None and v[j] < v[j - 1]

    got = {r["key"]: r["run"] for r in pr.longest_run(series, "v0 < before_v0", layout).collect()}
    assert got == {k: longest(v, falls) for k, v in data.items()}
    kept = rows(se.series_keys(pr.filter_by_run(series, "v0 < before_v0", 3, layout)))
    assert kept == sorted((k,) for k, v in data.items() if longest(v, falls) >= 3)


def test_fold_exists_forall(spark):
    series = spark.createDataFrame([(k, j, x) for k, v in {"a": [3.0, 1.0, 2.0], "b": [None, 5.0]}.items() for j, x in enumerate(v)],
                                   "key string, i bigint, v0 double")
    text = pr.fold_series(series, "string(v0)", "(a, b) -> concat_ws(',', a, b)", SeriesLayout(4))
    assert rows(text) == [("a", "3.0,1.0,2.0"), ("b", "5.0")]
    assert rows(se.series_keys(pr.filter_exists(series, "v0 = 5"))) == [("b",)]
    assert rows(se.series_keys(pr.filter_forall(series, "v0 < 9"))) == [("a",)]
