"""Forecast steps, labels and transition rules.

A *step* is one target position ``t`` of a series. It carries the raw values of
its target and of the up to three moments before it, so that the neighbours are
looked up once per series, however many models are tried on it afterwards:

``base``    v0[t-1], the last known price
``actual``  v0[t]
``move``    the rate of change into t, the consequent of a rule
``w0..wK``  per variable the values one, two and three moments ago (NULL where
            the series has not begun); w0 holds rates, w1..wK covariates

A model is a row of cut arrays ``(key, model[, ind], c0..cK)``: c0 cuts the
rate, ck covariate vk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import label_of
from ..settle import spread
from .layout import LOOK_BACK, SeriesLayout, own_rows, per_cell, with_blocks
from .series import value_columns

ORDERS = (1, 2, 3)


@dataclass(frozen=True)
class Sets:
    """Upper limits of labels per variable: a cut array holds fewer points."""

    price: int = 10
    item: int = 10

    def __post_init__(self):
        if min(self.price, self.item) < 3:
            raise ValueError("a variable needs room for at least 3 labels")

    @property
    def radix(self) -> int:
        return max(self.price, self.item)

    def limit(self, var: int) -> int:
        return self.price if var == 0 else self.item


def model_ids(models: DataFrame) -> list[str]:
    return [c for c in ("model", "ind") if c in models.columns]


def cut_columns(models: DataFrame) -> list[str]:
    k = 0
    while f"c{k}" in models.columns:
        k += 1
    return [f"c{j}" for j in range(k)]


def checked_models(models: DataFrame, sets: Sets, others: Sequence[str] = ()) -> DataFrame:
    """``(key, ids, c0..cK)`` and ``others``; a cut array that is empty, too long or holds NaN
    or NULL stops the job instead of giving wrong labels. A model without cuts (all
    arrays NULL: its series could not be trained) forecasts nothing and is left out."""

    def checked(k: int, c: str) -> str:
        most = sets.limit(k) - 1
        return (
            f"if(size({c}) between 1 and {most} and not exists({c}, x -> x is null or isnan(x)), {c}, "
            f"cast(raise_error('bad cut array {c}: need 1 to {most} finite cuts') as array<double>)) as {c}"
        )

    cuts = cut_columns(models)
    trained = models.where(" or ".join(f"{c} is not null" for c in cuts))
    return trained.selectExpr("key", *model_ids(models), *[checked(k, c) for k, c in enumerate(cuts)], *others)


def forecast_steps(
    series: DataFrame, layout: SeriesLayout = SeriesLayout(), aligned: bool = True
) -> DataFrame:
    """One row per position of an indexed series, see the module text.

    ``aligned=True`` (training) pairs a rate with the covariates of the day the
    rate ends on, ``aligned=False`` with those of the day it starts on.
    """
    values = value_columns(series)
    blocked = with_blocks(series.select("key", "i", *values), layout, behind=LOOK_BACK)
    blocked = spread(blocked, layout.cell)

    def back(v: str, by: int) -> str:
        return f"lag({v}, {by}) over cell" if by else v

    def rate(by: int) -> str:
        return f"try_divide({back('v0', by)} - {back('v0', by + 1)}, {back('v0', by + 1)})"

    columns = [
        f"{back('v0', 1)} as base",
        "v0 as actual",
        f"{rate(0)} as move",
        f"array({rate(1)}, {rate(2)}, {rate(3)}) as w0",
    ]
    for k, v in enumerate(values[1:], start=1):
        if aligned:  # the value on day 0 has no rate that ends on it
            past = [f"if(i > {d}, {back(v, d)}, null)" for d in (1, 2, 3)]
        else:
            past = [back(v, d) for d in (2, 3, 4)]
        columns.append(f"array({', '.join(past)}) as w{k}")
    cell = f"(partition by {', '.join(layout.cell)} order by i)"
    columns = [c.replace("over cell", f"over {cell}") for c in columns]
    return own_rows(blocked.selectExpr(*layout.cell, "i as t", *columns), layout, "t")


def all_terms(models: DataFrame) -> list[tuple[int, int]]:
    """(variable, order) of every rule: all variables, all orders."""
    return [(k, o) for k in range(len(cut_columns(models))) for o in ORDERS]


def covariate_terms(models: DataFrame) -> list[tuple[int, int]]:
    return [(k, o) for k, o in all_terms(models) if k > 0]


def label_steps(
    steps: DataFrame,
    models: DataFrame,
    terms: list[tuple[int, int]],
    layout: SeriesLayout,
    sets: Sets,
    extra: tuple[str, ...] = (),
    since: int = 0,
) -> DataFrame:
    """Steps x models with the consequent label ``p`` and per term the
    antecedent ``codes`` (labels as digits in base ``sets.radix``, oldest first;
    NULL while the series is too young). ``extra`` model columns are kept, and
    only steps from position ``since`` on."""
    # steps are laid out and sorted by cell already; only the models move
    placed = spread(per_cell(models, steps, layout), layout.cell)
    rows = steps.where(f"t >= {since}") if since else steps
    kept = [*layout.cell, *model_ids(models), "base", "actual", *extra]
    # Labels occur in the codes of several orders; Spark computes each once per row.
    # The array functions in p and t (which changes nothing) keep this projection out of
    # the fused whole-stage method, whichever of them is used later: all labels in there
    # would make it too large for the JIT, while on its own it is compiled in parts.
    codes = ", ".join(_code(k, order, sets) for k, order in terms)
    return rows.join(placed.hint("merge"), layout.cell).selectExpr(
        *kept,
        "element_at(transform(array(t), x -> x), 1) as t",
        f"{label_of('c0', 'move')} as p",
        f"array({codes}) as codes",
    )


def _code(var: int, order: int, sets: Sets) -> str:
    labels = [label_of(f"c{var}", f"w{var}[{back}]", sets.limit(var) - 1) for back in range(order)]
    code = f"bigint({labels[-1]})"
    for label in reversed(labels[:-1]):
        code = f"({code} * {sets.radix} + {label})"
    return code


def _spell(code: str, order: str, radix: int) -> str:
    digits = [f"int(({code} div {radix**d}) % {radix})" for d in (2, 1, 0)]
    return f"slice(array({', '.join(digits)}), -{order}, {order})"


def encode(antecedent: str, radix: int) -> str:
    """The inverse of the antecedent spelling in a rule table."""
    return f"aggregate({antecedent}, 0L, (code, x) -> code * {radix} + x)"


def mine_rules(
    series: DataFrame,
    models: DataFrame,
    var: int,
    order: int,
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
) -> DataFrame:
    """Count ``antecedent -> consequent``: ``order`` labels of one variable
    followed by a price label."""
    return mine_terms(forecast_steps(series, layout), models, [(var, order)], layout, sets)


def mine_all_rules(
    series: DataFrame,
    models: DataFrame,
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
) -> DataFrame:
    """All variables and orders in one pass:
    ``(key, ids, var, ord, antecedent, consequent, n)``."""
    return mine_terms(forecast_steps(series, layout), models, all_terms(models), layout, sets)


def mine_terms(
    steps: DataFrame,
    models: DataFrame,
    terms: list[tuple[int, int]],
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
) -> DataFrame:
    """Rules of several (variable, order) terms from ready-made steps. Counting
    combines inside the map tasks, so a hot series sends only its distinct rules."""
    ids = model_ids(models)
    variables, orders = (", ".join(str(term[j]) for term in terms) for j in (0, 1))
    return (
        _grams(steps, models, terms, layout, sets)
        .groupBy("key", *ids, "slot", "code", "consequent")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("consequent is not null")
        .selectExpr(
            "key", *ids, f"array({variables})[slot] as var", f"array({orders})[slot] as ord",
            "code", "consequent", "n",
        )
        .selectExpr(
            "key", *ids, "var", "ord",
            f"{_spell('code', 'ord', sets.radix)} as antecedent", "consequent", "n",
        )
    )


def _grams(steps, models, terms, layout, sets) -> DataFrame:
    """``(key, ids, consequent, slot, code)``: every antecedent and what followed,
    NULL if the next rate is undefined; slot is the place of its term in ``terms``."""
    labelled = label_steps(steps, checked_models(models, sets), terms, layout, sets, since=2)
    # the outer form: for the plain one Spark would add a test that codes has entries,
    # and compute all labels a second time for it
    return labelled.selectExpr(
        "key", *model_ids(models), "p as consequent", "posexplode_outer(codes) as (slot, code)"
    ).where("code is not null")


def antecedent_counts(
    steps: DataFrame,
    models: DataFrame,
    terms: list[tuple[int, int]],
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
) -> DataFrame:
    """``(key, ids, slot, code, counts)``: the rules with one row per antecedent,
    ``counts[c]`` being the count of consequent c."""
    counts = ", ".join(f"count_if(consequent = {c})" for c in range(sets.price))
    return (
        _grams(steps, models, terms, layout, sets)
        .groupBy("key", *model_ids(models), "slot", "code")
        .agg(F.expr(f"array({counts})").alias("counts"))
    )


def rule_counts(rules: DataFrame, terms: list[tuple[int, int]], sets: Sets = Sets()) -> DataFrame:
    """A rule table in the form of :func:`antecedent_counts`."""
    ids = model_ids(rules)
    cases = " ".join(f"when var = {k} and ord = {o} then {s}" for s, (k, o) in enumerate(terms))
    counts = ", ".join(f"sum(if(consequent = {c}, n, 0))" for c in range(sets.price))
    return (
        rules.selectExpr(
            "key", *ids, f"case {cases} end as slot", f"{encode('antecedent', sets.radix)} as code",
            "consequent", "n",
        )
        .where("slot is not null")
        .groupBy("key", *ids, "slot", "code")
        .agg(F.expr(f"array({counts})").alias("counts"))
    )


def discretize(
    series: DataFrame,
    models: DataFrame,
    layout: SeriesLayout = SeriesLayout(),
    sets: Sets = Sets(),
) -> DataFrame:
    """``(key, ids, var, i, label)``: variable 0 is the change rate from i to
    i+1, variable k the covariate vk at i."""
    values = value_columns(series)
    ids = model_ids(models)
    blocked = with_blocks(series.select("key", "i", *values), layout, ahead=1)
    following = f"over (partition by {', '.join(layout.cell)} order by i)"
    rated = own_rows(
        blocked.selectExpr(
            *layout.cell, "i as t", f"lead(i) {following} is not null as has_next",
            f"try_divide(lead(v0) {following} - v0, v0) as v0", *values[1:],
        ),
        layout, "t",
    )
    placed = per_cell(checked_models(models, sets), rated, layout)
    entries = ", ".join(
        f"named_struct('var', {k}, 'label', {label_of(f'c{k}', v)})" for k, v in enumerate(values)
    )
    return (
        rated.join(placed, layout.cell)
        .selectExpr("key", *ids, "t as i", "has_next", f"inline(array({entries}))")
        .where("var > 0 or has_next")
        .select("key", *ids, "var", "i", "label")
    )


def align_covariates(labels: DataFrame) -> DataFrame:
    """Drop the first label of every covariate, so that covariate label i
    belongs to the day on which rate i ends."""
    ids = model_ids(labels)
    moved = labels.selectExpr("key", *ids, "var", "if(var > 0, i - 1, i) as i", "label")
    return moved.where("i >= 0")
