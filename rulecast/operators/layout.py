"""How the rows of a series are spread over tasks.

A *cell* is the unit that windows and joins work on. When every series is short
enough, a cell is a whole series. Otherwise a series is cut by position into
blocks of ``block_rows``, so that no task ever needs a whole hot series, and
neighbours across a block edge are supplied by copying the few edge rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions a forecast step looks back from its target.
LOOK_BACK = 4

#: Rows that a task may hold of a series.
BLOCK_ROWS = 250_000

#: Blocks that a table is cut into before its blocks grow.
MANY_BLOCKS = 2_000


@dataclass(frozen=True)
class SeriesLayout:
    """``whole_keys=True`` states that no series is longer than ``block_rows``,
    ``longest`` how long the longest is; :func:`measure_layout` finds out. The
    default is right for any length."""

    block_rows: int = BLOCK_ROWS
    whole_keys: bool = False
    longest: int | None = None

    def __post_init__(self):
        if self.block_rows < LOOK_BACK:
            raise ValueError(f"block_rows must be at least {LOOK_BACK}")

    @property
    def cell(self) -> list[str]:
        return ["key"] if self.whole_keys else ["key", "block"]


def measure_layout(observations: DataFrame, block_rows: int = BLOCK_ROWS) -> SeriesLayout:
    """Count the longest series (one pre-aggregated pass over the key column)
    and pick the layout."""
    longest = observations.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    return SeriesLayout(block_rows, longest <= block_rows, longest)


def grow_blocks(layout: SeriesLayout, observations: DataFrame) -> SeriesLayout:
    """``layout`` with blocks that grow with the table, up to ``BLOCK_ROWS`` rows. Models and
    what was counted of them meet every block, so blocks of a fixed few rows would copy them
    as often as the table has such blocks. Results don't depend on it."""
    rows = min(-(-observations.count() // MANY_BLOCKS), BLOCK_ROWS)
    return replace(layout, block_rows=max(layout.block_rows, rows))


def with_blocks(series: DataFrame, layout: SeriesLayout, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Give every row its block, plus copies of the rows that the neighbouring
    block needs to look ``behind`` or ``ahead`` (at most ``block_rows``)."""
    if layout.whole_keys:
        return series
    spots = ["i"] + ([f"i + {behind}"] if behind else []) + ([f"greatest(i - {ahead}, 0)"] if ahead else [])
    blocks = ", ".join(f"({spot}) div {layout.block_rows}" for spot in spots)
    return series.selectExpr("*", f"explode(array_distinct(array({blocks}))) as block")


def own_rows(blocked: DataFrame, layout: SeriesLayout, position: str = "i") -> DataFrame:
    """Drop the copies made by :func:`with_blocks`."""
    if layout.whole_keys:
        return blocked
    return blocked.where(f"{position} div {layout.block_rows} = block")


def per_cell(per_key: DataFrame, steps: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Repeat a per-key table for every block of its series, so it can meet the
    rows in an evenly spread join. ``steps`` has one row ``t`` per position."""
    if layout.whole_keys:
        return per_key
    firsts = steps.where(f"t % {layout.block_rows} = 0").select("key", "block")
    return per_key.join(firsts, "key")
