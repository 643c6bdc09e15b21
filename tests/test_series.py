"""Series operators: small cases, edge cases, and independence of the layout."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rulecast.operators import series as se
from rulecast.operators.layout import SeriesLayout, measure_layout
from rulecast.operators.rules import forecast_steps

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, v0 double, v1 double"
WHOLE = SeriesLayout(whole_keys=True)


def table(spark, series):
    rows = [
        (key, DAY + dt.timedelta(days=d), float(p), float(x))
        for key, points in series.items()
        for d, (p, x) in enumerate(points)
    ]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def skewed(spark):
    """One key holds most rows; its days are uneven."""
    draw = random.Random(1)
    rows = [("hot", DAY + dt.timedelta(minutes=int(draw.random() ** 3 * 90000)), draw.random() + 1, draw.random()) for _ in range(700)]
    rows += [(f"k{j % 9}", DAY + dt.timedelta(days=j), draw.random() + 1, draw.random()) for j in range(180)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_and_rate(spark):
    series = se.index_series(table(spark, {"a": [(100, 1), (110, 2), (99, 3)], "b": [(5, 0)]}))
    assert [r["v0"] for r in series.where("key = 'a'").orderBy("i").collect()] == [100, 110, 99]
    got = rows(se.change_rate(series))
    assert [(k, i) for k, i, _ in got] == [("a", 0), ("a", 1)]
    assert [r for _, _, r in got] == pytest.approx([0.1, -0.1])


def test_zero_price_gives_null(spark):
    series = se.index_series(table(spark, {"a": [(0, 1), (2, 1), (3, 1)]}))
    assert [r["rate"] for r in se.change_rate(series).orderBy("i").collect()] == [None, 0.5]


def test_equal_times_are_ordered_by_values(spark):
    data = [("a", DAY, 3.0, 0.0), ("a", DAY, 1.0, 0.0), ("a", DAY, 2.0, 0.0)]
    series = se.index_series(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert [r["v0"] for r in series.orderBy("i").collect()] == [1, 2, 3]


def test_measured_layout(spark):
    data = skewed(spark)
    assert measure_layout(data, 1000) == SeriesLayout(1000, True, 700)
    assert not measure_layout(data, 50).whole_keys
    with pytest.raises(ValueError):
        SeriesLayout(block_rows=3)


@pytest.mark.parametrize("block_rows", [4, 13, 100, 5000])
def test_any_layout_gives_the_same(spark, block_rows):
    data = skewed(spark)
    blocks = SeriesLayout(block_rows)
    series = se.index_series(data, WHOLE)
    assert rows(se.index_series(data, blocks)) == rows(series)
    assert rows(se.change_rate(series, blocks)) == rows(se.change_rate(series, WHOLE))
    assert rows(se.series_range(series, blocks)) == rows(se.series_range(series, WHOLE))
    for aligned in (True, False):
        got = forecast_steps(series, blocks, aligned).drop("block")
        assert rows(got) == rows(forecast_steps(series, WHOLE, aligned))


@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_other_time_types(spark, kind):
    data = skewed(spark).withColumn("ts", F.col("ts").cast(kind))
    assert rows(se.index_series(data, SeriesLayout(40))) == rows(se.index_series(data, WHOLE))


def test_assembly(spark):
    points = [(float(p), float(-p)) for p in range(1, 8)]
    series = se.index_series(table(spark, {"a": points, "b": [(1, 2)]}))
    by_time = {(r["key"], r["block"]): r["series"] for r in se.assemble_by_time(series, SeriesLayout(4)).collect()}
    assert by_time["a", 0] == [list(p) for p in points[:4]]
    assert by_time["a", 1] == [list(p) for p in points[4:]]
    by_var = se.assemble_by_var(series).where("key = 'a'").first()["series"]
    assert by_var == [[p for p, _ in points], [x for _, x in points]]
    back = se.transpose_series(se.assemble_by_var(series)).where("key = 'a'").first()["series"]
    assert back == [list(p) for p in points]


def test_lookup_and_filter(spark):
    series = se.index_series(table(spark, {"a": [(1, 1), (9, 1)], "b": [(2, 1)], "c": [(3, 1)]}))
    assert rows(se.series_keys(series)) == [("a",), ("b",), ("c",)]
    assert se.find_series(series, "a").count() == 2
    assert se.find_series(series, "none").count() == 0
    assert rows(se.series_keys(se.filter_series(series, F.max("v0") > 2))) == [("a",), ("c",)]


def test_stats(spark):
    series = se.index_series(table(spark, {"a": [(1, 1), (3, 1)]}))
    r = se.series_stats(series).first()
    assert (r["n"], r["mean_v0"], r["std_v0"], r["min_v0"], r["max_v0"]) == (2, 2.0, 1.0, 1.0, 3.0)


def test_ranges_follow_rows_and_not_the_clock(spark):
    """Neither an outlying time, nor one second, nor equal rows make a large slice."""
    from rulecast.operators.positions import in_ranges, numbered

    days = spark.range(9000).selectExpr("'a' as key", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, int(id)) as ts", "double(id) as v0")
    second = spark.range(9000).selectExpr("'b' as key", "timestamp_ntz'2020-01-01' as ts", "double(pmod(hash(id), 5000)) as v0")
    equal = spark.range(9000).selectExpr("'c' as key", "timestamp_ntz'2020-01-01' as ts", "1D as v0")
    outlier = spark.sql("select 'a' as key, timestamp_ntz'1700-01-01' as ts, -1D as v0")
    data = days.union(second).union(equal).union(outlier).repartition(5)
    sizes = [r["count"] for r in in_ranges(data, ["key", "ts", "v0"], 55).groupBy("_range").count().collect()]
    assert sum(sizes) == 27001 and max(sizes) <= 1000
    series = se.index_series(data, SeriesLayout(1000))
    assert rows(series.groupBy("key").agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i"))) == [
        ("a", 9001, 9001, 0, 9000), ("b", 9000, 9000, 0, 8999), ("c", 9000, 9000, 0, 8999)]
    assert series.where("key = 'a' and i <> v0 + 1").isEmpty()
    places = rows(numbered(data.select("v0"), ["v0"], 7).groupBy().agg(F.countDistinct("pos"), F.max("pos")))
    assert places == [(27001, 27000)]
    assert numbered(data.limit(0), ["v0"], 7).isEmpty()


def test_short_blocks_do_not_make_more_ranges_than_tasks():
    """36 million rows in blocks of 250 were 288,000 ranges."""
    assert se.range_count(36_000_000, SeriesLayout(block_rows=250), 200) == 200
    assert se.range_count(200_000_000, SeriesLayout(block_rows=250), 200) == 800
    assert se.range_count(1_000, SeriesLayout(block_rows=250), 200) == 8


def test_blocks_grow_with_the_table(spark):
    from rulecast.operators.layout import BLOCK_ROWS, MANY_BLOCKS, grow_blocks

    few, many, most = (spark.range(n) for n in (1_000, MANY_BLOCKS * 300, MANY_BLOCKS * BLOCK_ROWS * 2))
    layout = SeriesLayout(block_rows=250)
    assert [grow_blocks(layout, t).block_rows for t in (few, many, most)] == [250, 300, BLOCK_ROWS]
