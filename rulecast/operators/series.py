"""Keyed series: indexing, assembly, look-up, rates and ranges.

Observations are ``(key, ts, v0..vK)``: v0 is the forecast target, v1..vK are
covariates. The canonical series adds the position ``i`` (0-based) in time
order; rows with equal time are ordered by their values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settle import broadcast_if_small, settle, spread
from .layout import SeriesLayout, measure_layout, own_rows, with_blocks
from .positions import in_ranges


#: Rows of long series that are sorted in one task.
RANGE_ROWS = 250_000


def value_columns(df: DataFrame) -> list[str]:
    """The columns v0..vK of a table, in order."""
    found = [c for c in df.columns if re.fullmatch(r"v\d+", c)]
    return sorted(found, key=lambda c: int(c[1:]))


def index_series(observations: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """``(key, i, ts, v0..vK)`` with ``i`` the position of a row in its series.

    Series of up to ``block_rows`` rows are numbered by one window per key. The rows of
    longer ones are sorted together into ranges by (key, ts, values), as many as their
    count and the tasks ask for, however short the blocks are; a row's position is its place in the range, less where its series
    begins there, plus the rows of the series in earlier ranges. Ranges follow the rows
    and not the clock, so that neither one outlying time nor any number of rows at one
    moment makes a large one.
    """
    layout = layout or measure_layout(observations)
    values = value_columns(observations)
    table = observations.select("key", "ts", *values)
    if layout.whole_keys:
        return _numbered_by_key(spread(table, ["key"]), values)

    long_keys = settle(series_sizes(table).where(F.col("n") > layout.block_rows))
    known = long_keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_long, long_rows = known[0], known[1] or 0
    if n_long == 0:
        return _numbered_by_key(table, values)
    listed = broadcast_if_small(long_keys.select("key"), n_long)
    ranges = range_count(long_rows, layout, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = in_ranges(table.join(listed, "key", "left_semi"), ["key", "ts", *values], ranges)
    earlier = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        laid.groupBy("_range", "key")
        .agg(F.min("_nth").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("_range", "key", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    )
    # a series lies in consecutive ranges, so there are at most ranges + n_long parts
    placed = laid.join(broadcast_if_small(parts, ranges + n_long), ["_range", "key"]).select(
        "key", (F.col("shift") + F.col("_nth")).cast("bigint").alias("i"), "ts", *values
    )
    return _numbered_by_key(table.join(listed, "key", "left_anti"), values).union(placed)


def range_count(rows: int, layout: SeriesLayout, tasks: int) -> int:
    """Ranges for ``rows`` of long series: two a block, but not more than ``tasks`` or than
    ranges of ``RANGE_ROWS``."""
    return min(-(-2 * rows // layout.block_rows), max(tasks, -(-rows // RANGE_ROWS)))


def _numbered_by_key(table: DataFrame, values: list[str]) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("key").orderBy("ts", *values))
    return table.select("key", (at - 1).cast("bigint").alias("i"), "ts", *values)


def series_keys(series: DataFrame) -> DataFrame:
    """One row per key: the first position of each series, so no distinct."""
    return series.where(F.col("i") == 0).select("key")


def model_keys(models: DataFrame) -> DataFrame:
    """The keys of a model table, which may hold several models a key."""
    return models.select("key").distinct()


def find_series(series: DataFrame, key: str) -> DataFrame:
    """All rows of one series. On a table that was just indexed all series are read, as
    positions come first; :func:`rulecast.sources.store.stored_series` reads one only."""
    return series.where(F.col("key") == key)


def filter_series(series: DataFrame, having: Column) -> DataFrame:
    """Keep the series whose aggregate condition holds, e.g.
    ``filter_series(s, F.max("v0") > 100)``; a condition on the key alone may use
    ``F.first("key")``. The condition is pre-aggregated; the rows stay put in a
    semi join, which adaptive execution splits when a key is hot."""
    kept = series.groupBy("key").agg(having.alias("_keep")).where("_keep").select("key")
    return series.join(kept, "key", "left_semi")


def series_sizes(series: DataFrame) -> DataFrame:
    """``(key, n)``."""
    return series.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def assemble_by_time(series: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """Time-major arrays ``(key, block, series)``: ``series[j]`` is the vector
    (v0..vK) at position ``block * block_rows + j``. A series of up to
    ``block_rows`` points is one row; a longer one is a row per block."""
    values = value_columns(series)
    point = F.struct("i", F.array(*values).alias("x"))
    block = F.floor(F.col("i") / F.lit(layout.block_rows)).cast("bigint").alias("block")
    return (
        series.groupBy("key", block)
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .select("key", "block", F.col("points.x").alias("series"))
    )


def assemble_by_var(series: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """Variable-major arrays: ``series[k]`` is variable k over time."""
    return transpose_series(assemble_by_time(series, layout))


def transpose_series(assembled: DataFrame) -> DataFrame:
    """Swap the two array levels of an assembled table (its own inverse)."""
    outer = F.col("series")
    widest = F.sequence(F.lit(1), F.size(F.element_at(outer, 1)))
    return assembled.withColumn(
        "series", F.transform(widest, lambda k: F.transform(outer, lambda row: F.element_at(row, k)))
    )


def change_rate(series: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """``(key, i, rate)``: ``rate[i] = (v0[i+1] - v0[i]) / v0[i]``, one row less
    than the series. A zero price gives NULL."""
    blocked = with_blocks(series.select("key", "i", "v0"), layout, ahead=1)
    over = f"over (partition by {', '.join(layout.cell)} order by i)"
    rated = blocked.selectExpr(
        *layout.cell, "i", f"lead(i) {over} is not null as has_next",
        f"try_divide(lead(v0) {over} - v0, v0) as rate",
    )
    return own_rows(rated, layout).where("has_next").select("key", "i", "rate")


def series_range(series: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """``(key, lo, hi)``: arrays over the variables. Entry 0 is the range of the
    change rate, entry k the range of covariate vk. NaN does not count; an entry is NULL
    where nothing else is left."""
    values = value_columns(series)
    blocked = with_blocks(series.select("key", "i", *values), layout, ahead=1)
    over = f"over (partition by {', '.join(layout.cell)} order by i)"
    rated = blocked.selectExpr(
        *layout.cell, "i", f"try_divide(lead(v0) {over} - v0, v0) as v0", *values[1:]
    )
    return own_rows(rated, layout).groupBy("key").agg(
        F.array(*[F.expr(f"min(nullif({v}, double('NaN')))") for v in values]).alias("lo"),
        F.array(*[F.expr(f"max(nullif({v}, double('NaN')))") for v in values]).alias("hi"),
    )


def series_stats(series: DataFrame) -> DataFrame:
    """``(key, n, mean_v0, std_v0, min_v0, max_v0, ...)`` for every variable."""
    stats = [F.count(F.lit(1)).alias("n")]
    for v in value_columns(series):
        stats += [
            F.avg(v).alias(f"mean_{v}"),
            F.stddev_pop(v).alias(f"std_{v}"),
            F.min(v).alias(f"min_{v}"),
            F.max(v).alias(f"max_{v}"),
        ]
    return series.groupBy("key").agg(*stats)
