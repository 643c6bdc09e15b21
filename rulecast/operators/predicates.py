"""Conditions on a whole series that depend on the order of its values.

A fold over a series of any length is made of block states: the elements of a block are merged
in order, then the blocks of the series. So the merge must be associative, as for counts,
extremes, sums, first and last values, or runs; the state is an SQL expression of a position
and may look at the row before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import SeriesLayout, own_rows, with_blocks
from .series import value_columns


def fold_series(series: DataFrame, state: str, merge: str, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """``(key, state)``: ``state``, SQL over the columns of a position (i, v0..vK and, of the
    position before, before_v0..before_vK, NULL for the first), merged in order by ``merge``,
    an SQL lambda ``(a, b) -> ...`` of two neighbouring states."""
    values = value_columns(series)
    blocked = with_blocks(series.select("key", "i", *values), layout, behind=1)
    over = f"over (partition by {', '.join(layout.cell)} order by i)"
    with_last = blocked.selectExpr("*", *[f"lag({v}) {over} as before_{v}" for v in values])
    # blocks are cut by position, also where a cell is a whole series
    block = f"i div {layout.block_rows} as at"
    each = own_rows(with_last, layout).selectExpr("key", block, "i", f"{state} as state")
    inside = each.groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("i", "state"))).alias("parts"))
    blocks = inside.selectExpr("key", "at", f"{_merged(merge)} as state")
    whole = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), "state"))).alias("parts"))
    return whole.selectExpr("key", f"{_merged(merge)} as state")


def _merged(merge: str) -> str:
    """The states of ``parts`` (in order, at least one) merged from the left."""
    states = "transform(parts, x -> x.state)"
    return f"reduce(slice({states}, 2, size(parts)), element_at({states}, 1), {merge})"


def longest_run(series: DataFrame, condition: str, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """``(key, run)``: the most positions in a row for which ``condition`` holds, SQL as in
    :func:`fold_series`; where it is NULL it doesn't hold."""
    hit = f"if({condition}, 1L, 0L)"
    state = f"named_struct('n', 1L, 'head', {hit}, 'tail', {hit}, 'best', {hit})"
    merge = (
        "(a, b) -> named_struct('n', a.n + b.n, 'head', if(a.head = a.n, a.n + b.head, a.head), "
        "'tail', if(b.tail = b.n, a.tail + b.n, b.tail), 'best', greatest(a.best, b.best, a.tail + b.head))"
    )
    return fold_series(series, state, merge, layout).selectExpr("key", "state.best as run")


def filter_by_run(series: DataFrame, condition: str, least: int, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """The series in which ``condition`` holds ``least`` times in a row."""
    kept = longest_run(series, condition, layout).where(F.col("run") >= least).select("key")
    return series.join(kept, "key", "left_semi")


def filter_exists(series: DataFrame, condition: str) -> DataFrame:
    """The series with a position for which ``condition`` (SQL over i, ts, v0..vK) holds."""
    return _filter_any(series, f"coalesce(bool_or({condition}), false)")


def filter_forall(series: DataFrame, condition: str) -> DataFrame:
    """The series for whose every position ``condition`` holds; NULL doesn't."""
    return _filter_any(series, f"bool_and(coalesce({condition}, false))")


def _filter_any(series: DataFrame, kept: str) -> DataFrame:
    keys = series.groupBy("key").agg(F.expr(kept).alias("_keep")).where("_keep").select("key")
    return series.join(keys, "key", "left_semi")
