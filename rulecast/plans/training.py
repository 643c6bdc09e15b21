"""Fitness and search: from indexed series to models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forecast import count_bits, first_moves, forecast_in_sample, forecast_terms, price_from_rate, rmse
from ..operators.layout import SeriesLayout
from ..operators.population import Search, init_population, next_generation, select_elite
from ..operators.rules import Sets, antecedent_counts, covariate_terms, cut_columns, forecast_steps
from ..operators.series import series_range, value_columns
from ..settle import discard, scratch_path, settle, settle_by, spread
from .batch_fitness import STRATEGIES, batch_fitness, gathered_steps

PACKED_ROWS = 1 << 13  # of a series that are one row for the task that reads the series
_PACKED = "key {}, block bigint, rows binary"


def evaluate_population(
    series: DataFrame,
    population: DataFrame,
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
    strategy: str = "batch",
    **options,
) -> DataFrame:
    """The population with its ``fitness``: the in-sample forecast RMSE of every
    individual on its own series."""
    steps = forecast_steps(series, layout)
    if not layout.whole_keys:  # blocks are read several times
        steps = settle(steps)
    return evaluate_steps(steps, first_moves(series, sets), population, layout, sets, strategy, **options)


def evaluate_steps(
    steps: DataFrame,
    moves: DataFrame,
    population: DataFrame,
    layout: SeriesLayout,
    sets: Sets,
    strategy: str = "batch",
    consequent: str = "by_position",
    rate_divisor: float = 100.0,
    slices: int = 1,
) -> DataFrame:
    """:func:`evaluate_population` on ready-made steps.

    Both strategies take series of any length and give the same. ``batch`` counts and
    forecasts in Arrow batches, a cell and all its individuals at a time; ``relational``
    mines, looks up and averages with Spark operators alone.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    terms = covariate_terms(population)
    if terms and strategy == "batch":
        return batch_fitness(steps, moves, population, layout, sets, consequent, rate_divisor, slices)
    if terms and count_bits(layout):
        forecast = forecast_in_sample(steps, moves, population, layout, sets, consequent)
    else:
        counts = antecedent_counts(steps, population, terms, layout, sets) if terms else None
        forecast = forecast_terms(
            steps, moves, counts, population, terms, layout, sets, consequent=consequent
        )
    fitness = rmse(price_from_rate(forecast, rate_divisor)).withColumnRenamed("rmse", "fitness")
    return population.join(fitness, ["key", "model", "ind"], "left")


def fit_cuts(
    series: DataFrame,
    search: Search = Search(),
    layout: SeriesLayout = SeriesLayout(),
    strategy: str = "batch",
    **options,
) -> DataFrame:
    """Search cut points for every series: ``(key, model, c0..cK, fitness,
    max_price_set, max_item_set)``, one row per repeat.

    All series, repeats and individuals of a generation are one Spark job. The steps lie in
    buckets by cell (as a list a series, where all are short) and the population in buckets by key, so that a generation shuffles
    its scored individuals once and the steps never. The driver only counts generations;
    each is written, so lineage does not grow and lost executors cost one generation at
    most, and the one before it is deleted.

    A series without any rate, or without any value of a variable, cannot be trained: its
    models have NULL cuts and a NULL fitness.
    """
    spark = series.sparkSession
    variables = len(value_columns(series))
    if not layout.whole_keys and series.where(f"i >= {layout.block_rows}").isEmpty():
        layout = replace(layout, whole_keys=True)  # no series has a second block
    paths = [scratch_path(spark, name) for name in ("steps", "moves")]
    steps = forecast_steps(series, layout)
    if layout.whole_keys and strategy == "batch" and variables > 1:  # every generation takes them as lists
        steps = settle_by(gathered_steps(steps, [f"c{k}" for k in range(variables)], layout.cell), layout.cell, paths[0])
    else:
        steps = settle_by(steps, layout.cell, paths[0], ("t",))
    moves = settle_by(first_moves(series, search.sets), ["key"], paths[1])
    ranges = settle(series_range(series, layout))
    known = "not exists(concat(lo, hi), x -> x is null)"
    paths.append(scratch_path(spark, "population"))
    # spread, as the ranges may lie in few partitions and each becomes a population
    population = settle_by(init_population(spread(ranges.where(known), ["key"]), search, variables), ["key"], paths[-1])
    for gen in range(search.generations + 1):
        scored = evaluate_steps(steps, moves, population, layout, search.sets, strategy, **options)
        if gen < search.generations:  # offspring of the last one would not be looked at
            path = scratch_path(spark, "population")
            population = settle_by(next_generation(scored, search, gen), ["key"], path)
            discard(spark, paths.pop())
            paths.append(path)
    cuts = cut_columns(scored)
    untrained = ranges.where(f"not ({known})").selectExpr(
        "key", f"explode(sequence(1, {search.repeats})) as model",
        *[f"cast(null as array<double>) as {c}" for c in cuts], "cast(null as double) as fitness",
    )
    # settled, as scoring reads a model table several times
    models = settle(select_elite(scored, 1).select("key", "model", *cuts, "fitness").union(untrained).select(
        "*",
        F.lit(search.sets.price).alias("max_price_set"),
        F.lit(search.sets.item).alias("max_item_set"),
    ))
    for path in paths:
        discard(spark, path)
    return models


def train_series(
    series: DataFrame,
    trainer: Callable[[DataFrame], DataFrame] | None = None,
    values: list[str] | None = None,
    layout: SeriesLayout = SeriesLayout(),
    search: Search = Search(),
) -> DataFrame:
    """Train every series with ``trainer``, a function from an indexed series
    table to a model table; by default :func:`fit_cuts`. ``values=["v0"]`` trains
    on the price alone."""
    kept = values or value_columns(series)
    table = series.select("key", "i", *(["ts"] if "ts" in series.columns else []), *kept)
    if trainer is not None:
        return trainer(table)
    return fit_cuts(table, search, layout)


def train_series_with(
    series: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    layout: SeriesLayout,
) -> DataFrame:
    """Apply a user's Python trainer to every series as a pandas table in time
    order. It gets a whole series at once, so the layout must prove that all are
    short; :func:`train_series_streamed` takes any length."""
    if not layout.whole_keys:
        raise ValueError("a Python trainer needs series proven to fit one task; use train_series_streamed")

    def run(frames):
        for rows in _one_series_each(frames):
            yield function(rows)

    # sorted partitions cross to Python in large batches, not a stream for every series
    return spread(series, ["key"]).sortWithinPartitions("key", "i").mapInPandas(run, schema)


def _one_series_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each key of ``frames`` sorted by key; a missing key is one of its own."""
    parts: list[pd.DataFrame] = []  # of the series under way

    def whole() -> pd.DataFrame:
        return (parts[0] if len(parts) == 1 else pd.concat(parts)).reset_index(drop=True)

    for frame in frames:
        keys, missing = frame["key"].to_numpy(), frame["key"].isna().to_numpy()
        other = (keys[1:] != keys[:-1]) & ~(missing[1:] & missing[:-1])
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(frame)]
        for begin, end in pairwise(edges):
            if end == begin:
                continue
            if parts and begin == 0:
                last = parts[0]["key"].iloc[0]
                goes_on = last == keys[0] or bool(missing[0] and pd.isna(last))
            else:
                goes_on = False
            if parts and not goes_on:
                yield whole()
                parts = []
            parts.append(frame.iloc[begin:end])
    if parts:
        yield whole()


def train_series_streamed(
    series: DataFrame,
    function: Callable[[str, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Apply a user's Python trainer with a running state to every series: ``function(key,
    batches)`` reads the rows of a series in time order, a batch at a time, and yields rows
    of ``schema``. What the function leaves unread is skipped.

    Blocks of ``PACKED_ROWS`` rows are sorted first, by as many tasks as there are partitions,
    and packed into a compressed row each. So the task that reads a series sorts its packed
    blocks, a small part of its bytes, and no series is ever unpacked as a whole."""
    columns = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in series.columns])
    rows = series.select("key", F.expr(f"i div {PACKED_ROWS}").alias("block"), "i", columns.alias("row"))
    rows = spread(rows, ["key", "block"]).sortWithinPartitions("key", "block", "i")
    packed = rows.select("key", "block", "row").mapInArrow(_packed, _PACKED.format(series.schema["key"].dataType.simpleString()))
    at_once = int(series.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    size = at_once if at_once > 0 else PACKED_ROWS

    def blocks(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1))

    def run(batches):
        for key, some in groupby(blocks(batches), key=itemgetter(0)):
            yield from function(key, (piece for _, block in some for piece in _unpacked(block, size)))

    return spread(packed, ["key"]).sortWithinPartitions("key", "block").select("key", "rows").mapInArrow(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, row), sorted, to a row for each key and block, its rows as a Parquet file."""

    def pieces():
        for batch in batches:
            ends = [pc.run_end_encode(batch.column(c)).run_ends.to_pylist() for c in (0, 1)]
            rows, begin = pa.RecordBatch.from_struct_array(batch.column(2)), 0
            for end in sorted({*ends[0], *ends[1]}):
                yield batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py(), rows.slice(begin, end - begin)
                begin = end

    for (key, block), some in groupby(pieces(), key=itemgetter(0, 1)):
        table = pa.Table.from_batches([piece for _, _, piece in some])
        file = pa.BufferOutputStream()
        pq.write_table(table, file, compression="zstd")
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], table.schema.field("key").type), pa.array([block], pa.int64()), pa.array([file.getvalue().to_pybytes()], pa.binary())],
            names=["key", "block", "rows"])


def _unpacked(block: pa.BinaryScalar, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a packed block, at most ``size`` at a time."""
    yield from pq.read_table(pa.BufferReader(block.as_buffer())).to_batches(max_chunksize=size)
