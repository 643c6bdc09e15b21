"""Rule forecasts: the count-weighted mean of interval midpoints.

The sum over midpoints depends on a step only through its antecedent, so it is
done once per rule antecedent (the *book*) and not once per step. A step then
only looks its antecedents up and pools what it finds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import EDGE_OFFSET, interval_midpoints, label_of
from ..settle import spread
from .layout import SeriesLayout, per_cell
from .rules import (
    ORDERS,
    Sets,
    checked_models,
    covariate_terms,
    cut_columns,
    forecast_steps,
    label_steps,
    model_ids,
    rule_counts,
)
from .series import change_rate

#: Up to so many possible antecedents a model's book is one row of maps; above it the
#: lookup is a join on the antecedent.
MAP_ENTRIES = 50_000

#: How much a rule counts for midpoint j, F being the price labels of the series
#: that is forecast: ``by_position`` takes the count of consequent F[j] if label
#: j was ever seen, ``by_label`` the count of label j, ``unguarded`` the count
#: of F[j] in any case.
CONSEQUENTS = ("by_position", "by_label", "unguarded")


def first_moves(series: DataFrame, sets: Sets = Sets()) -> DataFrame:
    """``(key, moves)``: the first rates of each series, at most as many as
    there are midpoints. Only these few rows of a series are read."""
    few = series.where(f"i <= {sets.price}").select("key", "i", "v0")
    rates = change_rate(few, SeriesLayout(whole_keys=True))
    return (
        rates.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("i", "rate"))).alias("head"))
        .selectExpr("key", "head.rate as moves")
    )


def _weight(consequent: str, j: int, count: Callable[[str], str] = "get(counts, {})".format) -> str:
    """Weight of midpoint ``j``, from ``first_labels`` and the count of a consequent; 0 beyond
    the last midpoint."""
    if consequent == "by_label":
        weight = count(j)
    else:
        weight = f"coalesce({count(f'get(first_labels, {j})')}, 0)"
        if consequent == "by_position":
            weight = f"if({count(j)} > 0, {weight}, 0)"
    return f"double(if({j} < size(mids), {weight}, 0))"


def rule_book(
    counts: DataFrame,
    models: DataFrame,
    moves: DataFrame,
    sets: Sets = Sets(),
    consequent: str = "by_position",
    edge: float = EDGE_OFFSET,
) -> DataFrame:
    """``(key, ids, slot, code, u, d)``: weighted midpoint sum and weight of every
    antecedent, from ``antecedent_counts``."""
    if consequent not in CONSEQUENTS:
        raise ValueError(f"consequent must be one of {CONSEQUENTS}")
    ids = model_ids(models)
    compiled = checked_models(models, sets).join(moves, "key").selectExpr(
        "key", *ids,
        f"{interval_midpoints('c0', edge)} as mids",
        f"transform(moves, r -> {label_of('c0', 'r')}) as first_labels",
    )
    places = range(sets.price)
    found = ["key", *ids, "slot", "code"]
    return (
        spread(counts, ["key", *ids])
        .join(compiled, ["key", *ids])
        .selectExpr(*found, "mids", *[f"{_weight(consequent, j)} as y{j}" for j in places])
        .selectExpr(
            *found,
            " + ".join(f"y{j} * coalesce(get(mids, {j}), 0D)" for j in places) + " as u",
            " + ".join(f"y{j}" for j in places) + " as d",
        )
    )


def forecast_terms(
    steps: DataFrame,
    moves: DataFrame,
    counts: DataFrame | None,
    models: DataFrame,
    terms: list[tuple[int, int]],
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
    consequent: str = "by_position",
    edge: float = EDGE_OFFSET,
    lookup: str = "auto",
    by_variable: bool = False,
) -> DataFrame:
    """``(key, ids, [var,] t, base, actual, rate)`` for every step. ``rate`` pools the
    rules of all ``terms`` (or those of each variable), whose ``counts`` have the same
    slots; without a matching rule it is 0, and it is NULL for the first two positions,
    which have no rate before them."""
    ids = model_ids(models)
    sound = checked_models(models, sets)
    if not terms:  # no covariates: nothing to look up, the price stays
        placed = spread(per_cell(sound, steps, layout), layout.cell)
        return steps.join(placed.hint("merge"), layout.cell).selectExpr(
            "key", *ids, "t", "base", "actual", "if(t >= 2, 0D, null) as rate"
        )
    book = rule_book(counts, models, moves, sets, consequent, edge)
    entries = sum(sets.radix**order for _, order in terms)
    by_map = lookup == "map" or (lookup == "auto" and entries <= MAP_ENTRIES)
    pooled = _pool_by_map if by_map else _pool_by_join
    found = pooled(steps, book, sound, terms, layout, sets, by_variable)
    return found.selectExpr(
        "key", *ids, *(["var"] if by_variable else []), "t", "base", "actual", "if(t >= 2, if(d > 0, u / d, 0D), null) as rate"
    )


def _pool_by_map(steps, book, models, terms, layout, sets, by_variable) -> DataFrame:
    ids = model_ids(models)
    slots = range(len(terms))
    # the maps are made before the join, once per model and not per step
    pages = (
        # collect_list leaves NULLs out; a filter on d would be computed below the join
        book.selectExpr("key", *ids, "if(d > 0, struct(slot, code, struct(u, d) as hit), null) as entry")
        .groupBy("key", *ids)
        .agg(F.collect_list("entry").alias("page"))
        .selectExpr(
            "key", *ids,
            *[
                f"map_from_entries(transform(filter(page, e -> e.slot = {s}), "
                f"e -> struct(e.code, e.hit))) as m{s}"
                for s in slots
            ],
        )
    )
    labelled = label_steps(
        steps, models.join(pages, ["key", *ids], "left"), terms, layout, sets,
        extra=tuple(f"m{s}" for s in slots),
    )
    kept = ["key", *ids, "t", "base", "actual"]

    def total(x: str, some) -> str:
        return " + ".join(f"coalesce(h{s}.{x}, 0D)" for s in some) + f" as {x}"

    hits = labelled.selectExpr(*kept, *[f"try_element_at(m{s}, codes[{s}]) as h{s}" for s in slots])
    if not by_variable:
        return hits.selectExpr(*kept, total("u", slots), total("d", slots))
    own = {k: [s for s in slots if terms[s][0] == k] for k, _ in terms}
    sums = ", ".join(f"struct({k} as var, {total('u', some)}, {total('d', some)})" for k, some in own.items())
    return hits.selectExpr(*kept, f"inline(array({sums}))")


def _pool_by_join(steps, book, models, terms, layout, sets, by_variable) -> DataFrame:
    ids = model_ids(models)
    keys = [*layout.cell, *ids]
    entries = per_cell(book, steps, layout)
    asked = label_steps(steps, models, terms, layout, sets).selectExpr(
        *keys, "t", "base", "actual", "posexplode_outer(codes) as (slot, code)"
    )
    return (
        asked.join(entries, [*keys, "slot", "code"], "left")
        .withColumn("var", F.expr(f"array({', '.join(str(k) for k, _ in terms)})[slot]"))
        .groupBy(*keys, *(["var"] if by_variable else []), "t", "base", "actual")
        .agg(F.expr("coalesce(sum(u), 0D)").alias("u"), F.expr("coalesce(sum(d), 0D)").alias("d"))
    )


#: Up to so many bits a count is a part of a long in :func:`forecast_in_sample`.
COUNT_BITS = 20


def count_bits(layout: SeriesLayout) -> int | None:
    """Bits that hold every count of a series, if the layout proves that ``COUNT_BITS`` do."""
    bits = max(layout_rows(layout).bit_length(), 1)
    return bits if layout.whole_keys and bits <= COUNT_BITS else None


def layout_rows(layout: SeriesLayout) -> int:
    """Rows that a series has at most, if ``layout.whole_keys``."""
    return layout.block_rows if layout.longest is None else min(layout.longest, layout.block_rows)


def forecast_in_sample(
    steps: DataFrame,
    moves: DataFrame,
    models: DataFrame,
    layout: SeriesLayout,
    sets: Sets = Sets(),
    consequent: str = "by_position",
    edge: float = EDGE_OFFSET,
) -> DataFrame:
    """:func:`forecast_terms` for ``covariate_terms`` and steps that are their own training
    part, from position 2 on: the steps with equal antecedents count each other. A row is a step and
    an individual. Variable by variable the rows are sorted by their labels, the latest first, so the
    antecedents of every order are contiguous, one sort serves all orders, and no rule is stored, moved
    or looked up. Labels, counts and weights are packed into longs, as such rows are copied often."""
    if count_bits(layout) is None:
        raise ValueError("series must be proven short; use antecedent_counts and forecast_terms")
    if consequent not in CONSEQUENTS:
        raise ValueError(f"consequent must be one of {CONSEQUENTS}")
    ids = model_ids(models)
    variables = sorted({k for k, _ in covariate_terms(models)})
    places = range(sets.price)
    spots = _Packed("f", sets.price, sets.price)  # labels of the first moves, sets.price for none
    weights = _Packed("y", sets.price, layout_rows(layout) * len(ORDERS) * len(variables))
    counts = _Packed("n", sets.price, layout_rows(layout))
    compiled = checked_models(models, sets).join(moves, "key").selectExpr(
        "key", *ids, *cut_columns(models),
        f"{interval_midpoints('c0', edge)} as mids",
        f"transform(moves, r -> {label_of('c0', 'r')}) as first_labels",
    )
    first = [f"bigint(coalesce(if({j} < size(mids), get(first_labels, {j}), null), {sets.price}))" for j in places]
    packed = compiled.selectExpr("key", *ids, *cut_columns(models), "mids", *spots.pack(first))
    # digits in base radix + 1, as a missing label is one more
    base = sets.radix + 1
    codes = _Packed("k", len(variables), base ** max(ORDERS) - 1)
    # a row adds one to the count of its consequent
    ones = [f"if(p div {counts.each} = {n}, shiftleft(1L, p % {counts.each} * {counts.bits}), 0L) as one{n}" for n in range(len(counts.names))]
    moment = ["key", *ids, "t", "base", "actual", "mids"]
    own = [*ids, *cut_columns(models), "mids", *spots.names]
    members = spread(packed, ["key"]).groupBy("key").agg(F.collect_list(F.struct(*own)).alias("members"))
    lagged = [f"w{k}" for k in variables]
    rows = steps.where("t >= 2").join(members.hint("merge"), "key").selectExpr(
        "key", "t", "base", "actual", "move", *lagged, "posexplode(members) as (at, member)",
    ).selectExpr("key", "t", "base", "actual", "move", *lagged, "member.*").selectExpr(
        *[c for c in moment if c != "base"], *spots.names,
        # as that of t in label_steps, which would not be needed to the end here
        apart := "element_at(transform(array(base), x -> x), 1) as base",
        f"{label_of('c0', 'move', sets.price - 1)} as p",
        *codes.pack([_window_code(k, base, sets) for k in variables]),
    )
    moment += spots.names
    rows = rows.selectExpr(*moment, *codes.names, *ones)
    carried = [*moment, *codes.names, *[f"one{n}" for n in range(len(counts.names))]]
    who = ", ".join(["key", *ids])
    labels = ["a1", "a2", "a3"]
    for at in range(len(variables)):
        code = codes.at(at)
        rows = rows.selectExpr(
            "*", f"{code} div {base**2} as a1", f"{code} div {base} % {base} as a2", f"{code} % {base} as a3",
            # the hash says nothing new, but as the first column of the sort it decides nearly all of its comparisons
            f"xxhash64({who}, {code} div {base**2}) as met",
        )
        finer = None
        for order in reversed(ORDERS):  # the finest groups first: their order serves the others
            among = f"(partition by met, {', '.join([who, *labels[:order]])})"
            # windows that don't ask for the finer one are put below it by Spark, and each is sorted for
            ask = f"if({finer} is null, null, one{{0}})".format if finer else "one{0}".format
            rows = rows.selectExpr("*", *[f"sum({ask(n)}) over {among} as n{order}_{n}" for n in range(len(counts.names))])
            finer = f"n{order}_0"
        known = [
            f"if({' and '.join(f'{a} < {sets.radix}' for a in labels[:order])}, n{order}_{n}, 0L) as n{order}_{n}"
            for order in ORDERS for n in range(len(counts.names))
        ]
        sofar = weights.names if at else []
        found = weights.pack([
            " + ".join(_weight_of(consequent, j, spots.at(j), partial(counts.at, name=f"n{order}_")) for order in ORDERS) for j in places])
        if at:
            found = [f"{y} + {x}" for y, x in zip(weights.names, found)]
        rows = rows.selectExpr(*carried, *sofar, *known).selectExpr(*[c for c in carried if c != "base"], apart, *found)
    return (
        rows.selectExpr("key", *ids, "t", "base", "actual", "mids", *[f"{weights.at(j)} as w{j}" for j in places])
        .selectExpr(
            "key", *ids, "t", apart, "actual",
            " + ".join(f"w{j} * coalesce(get(mids, {j}), 0D)" for j in places) + " as u",
            " + ".join(f"w{j}" for j in places) + " as d",
        )
        .selectExpr("key", *ids, "t", "base", "actual", "if(d > 0, u / d, 0D) as rate")
    )


class _Packed:
    """``entries`` numbers of 0 to ``most`` as parts of the longs ``names``. Such longs can be
    added up as long as no entry exceeds ``most``."""

    def __init__(self, name: str, entries: int, most: int):
        self.bits = max(most.bit_length(), 1)
        self.each = 62 // self.bits
        self.name, self.entries = name, entries
        self.names = [f"{name}{n}" for n in range(-(-entries // self.each))]

    def pack(self, values: list[str]) -> list[str]:
        parts = [values[n * self.each:(n + 1) * self.each] for n in range(len(self.names))]
        return [
            " + ".join(f"shiftleft(bigint({x}), {j * self.bits})" for j, x in enumerate(part)) + f" as {name}"
            for part, name in zip(parts, self.names)
        ]

    def at(self, i: int | str, name: str | None = None) -> str:
        """Entry ``i``, a number or SQL; 0 beyond the last long."""
        name, mask = name or self.name, (1 << self.bits) - 1
        if isinstance(i, int):
            return f"(shiftright({name}{i // self.each}, {i % self.each * self.bits}) & {mask}L)"
        long = " ".join(f"when {i} < {(n + 1) * self.each} then {name}{n}" for n in range(len(self.names)))
        return f"(shiftright(case {long} else 0L end, int({i} % {self.each} * {self.bits})) & {mask}L)"


def _weight_of(consequent: str, j: int, spot: str, count: Callable[[int | str], str]) -> str:
    """:func:`_weight` from the label at position ``j``, which is beyond all labels if there is none."""
    if consequent == "by_label":
        return count(j)
    return f"if({count(j)} > 0, {count(spot)}, 0L)" if consequent == "by_position" else count(spot)


def _window_code(var: int, base: int, sets: Sets) -> str:
    """The labels of the last three moments, the latest first."""
    labels = [f"coalesce({label_of(f'c{var}', f'w{var}[{back}]', sets.limit(var) - 1)}, {sets.radix})" for back in range(3)]
    return f"bigint(({labels[0]} * {base} + {labels[1]}) * {base} + {labels[2]})"


def first_terms(models: DataFrame) -> list[tuple[int, int]]:
    """The terms of :func:`forecast_multivar`."""
    return price_terms(models) + [(k, o) for k, o in covariate_terms(models) if o == 1]


def price_terms(models: DataFrame) -> list[tuple[int, int]]:
    """The term of :func:`forecast_uni`, whatever the models."""
    return [(0, 1)]


def _forecast_series(series, rules, models, terms, aligned, layout, sets, **options) -> DataFrame:
    steps = forecast_steps(series, layout, aligned)
    moves = first_moves(series, sets)
    if terms and "counts" not in rules.columns:
        rules = rule_counts(rules, terms, sets)
    counts = rules if terms else None
    return forecast_terms(steps, moves, counts, models, terms, layout, sets, **options)


def forecast_multiorder(
    series, rules, models, aligned=False, layout=SeriesLayout(), sets=Sets(), **options
) -> DataFrame:
    """Pool orders 1 to 3 of every covariate (the forecaster models are scored
    with). ``rules`` is a rule table, or its :func:`~rulecast.operators.rules.antecedent_counts`
    for the terms of the forecaster (here ``covariate_terms``), as for the others below.
    ``aligned`` as in :func:`~rulecast.operators.rules.forecast_steps`."""
    terms = covariate_terms(models)
    return _forecast_series(series, rules, models, terms, aligned, layout, sets, **options)


def forecast_multivar(
    series, rules, models, aligned=False, layout=SeriesLayout(), sets=Sets(), **options
) -> DataFrame:
    """Pool the first order of the price and of every covariate."""
    return _forecast_series(series, rules, models, first_terms(models), aligned, layout, sets, **options)


def forecast_uni(series, rules, models, layout=SeriesLayout(), sets=Sets(), **options) -> DataFrame:
    """First order of the price alone, weights by the label seen at each position."""
    options.setdefault("consequent", "unguarded")
    return _forecast_series(series, rules, models, price_terms(models), True, layout, sets, **options)


def forecast_by_variable(
    series, rules, models, aligned=False, layout=SeriesLayout(), sets=Sets(), **options
) -> DataFrame:
    """The multi-order forecast of each covariate on its own, in one pass: ``(key, ids,
    var, t, base, actual, rate)``."""
    terms = covariate_terms(models)
    if not terms:
        raise ValueError("the models have no covariates")
    return _forecast_series(series, rules, models, terms, aligned, layout, sets, by_variable=True, **options)


def price_from_rate(forecast: DataFrame, rate_divisor: float = 100.0, keep_head: bool = False) -> DataFrame:
    """Add ``price_hat = base * (1 + rate / rate_divisor)``. The first two
    positions are dropped, or kept with their actual price."""
    price = f"base * (1 + rate / double({float(rate_divisor)!r}))"
    if keep_head:
        return forecast.selectExpr("*", f"if(t < 2, actual, {price}) as price_hat")
    return forecast.where("t >= 2").selectExpr("*", f"{price} as price_hat")


def rmse(priced: DataFrame, least: int = 1) -> DataFrame:
    """``(key, ids, rmse)`` over the rows of a priced forecast; with the head
    kept, its exact rows count in the denominator. NULL for fewer than ``least`` rows."""
    error = F.expr(f"if(count(*) >= {least}, sqrt(avg((price_hat - actual) * (price_hat - actual))), null)")
    return priced.groupBy("key", *model_ids(priced)).agg(error.alias("rmse"))
