"""Places in a global order, by sample sort.

Spark samples splitters for the order, deals the rows out by range and sorts every range
on its own. The sizes of the ranges, one number each, give their offsets. No range holds
more than its share, as rows that are equal in the whole order are told apart by their
place in the input, so that ties and a single hot value are split like anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settle import settle

#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def in_ranges(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """``rows`` in at most ``ranges`` sorted ranges, settled, with ``_range`` and the place
    ``_nth`` (from 0) in it."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = tied.repartitionByRange(max(1, ranges), *order, "_tie").sortWithinPartitions(*order, "_tie")
    place = F.monotonically_increasing_id()
    return settle(laid.drop("_tie").withColumn("_place", place)).select(
        *rows.columns,
        F.shiftright("_place", _ROW_BITS).alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_nth"),
    )


def numbered(rows: DataFrame, order: list[str], ranges: int, name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 0) in the global ``order``; ties in any order. The
    offsets that are broadcast have one row a range, so at most ``ranges``."""
    laid = in_ranges(rows, order, ranges)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return laid.join(F.broadcast(offsets), "_range").select(
        *rows.columns, (F.col("_before") + F.col("_nth")).alias(name)
    )
