"""Fitness of many individuals, counted in Arrow batches.

Spark brings the steps of a cell and the individuals of its series together. Where a cell
is a whole series, or a series has one block, it is a row of lists, and one pass over a batch
of such rows counts the rules, weighs the midpoints and forecasts, for many series at a time.
A longer series comes in blocks: each counts its own part of the rules, Spark adds the parts
and makes the rule book, and with it each block adds up its squared errors.

A value's label is the first cut above it, so only the running maximum of the cuts
matters: it is searched among the sorted values, once for all lags of a variable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import EDGE_OFFSET
from ..operators.forecast import rule_book
from ..operators.layout import SeriesLayout, per_cell
from ..operators.rules import ORDERS, Sets, checked_models, cut_columns, model_ids
from ..settle import broadcast_if_small

STRATEGIES = ("batch", "relational")

#: Labels held at a time; more individuals are done in several rounds.
_CELLS = 4_000_000

_WHO = ["key", "model", "ind"]
_MOMENT = ["t", "base", "actual", "move"]


def batch_fitness(
    steps: DataFrame,
    moves: DataFrame,
    population: DataFrame,
    layout: SeriesLayout,
    sets: Sets,
    consequent: str = "by_position",
    rate_divisor: float = 100.0,
    slices: int = 1,
) -> DataFrame:
    """``population`` with ``fitness`` as last column. ``slices`` splits the individuals of a
    series over that many tasks (for few series and many individuals). Individuals without
    a series, or with one too short, get NULL. Of individuals with equal cuts one is scored,
    and none if one has a ``known`` fitness. ``steps`` may be :func:`gathered_steps`."""
    if layout.whole_keys:
        return _whole_series(steps, population, sets, consequent, rate_divisor, slices)
    longer = steps.where(f"t = {layout.block_rows}").selectExpr("key as key").distinct()
    n_long = longer.count()
    longer = broadcast_if_small(longer, n_long)

    def having(table: DataFrame, how: str) -> DataFrame:
        # renamed, as both sides come from the steps
        return table.join(longer, "key", how).select(*[F.col(c).alias(c) for c in table.columns])

    known = population.where("key is not null")
    scored = _whole_series(
        having(steps.where("block = 0"), "left_anti"),
        having(known, "left_anti").withColumn("block", F.lit(0).cast("bigint")),
        sets, consequent, rate_divisor, slices, layout.cell,
    ).select(*_WHO, "fitness")
    if n_long:
        parted = having(steps, "left_semi")
        scored = scored.union(_in_blocks(parted, moves, having(known, "left_semi"), layout, sets, consequent, rate_divisor))
    return population.join(scored, _WHO, "left")


def _rows(steps: DataFrame, cuts: list[str], cell: list[str]) -> DataFrame:
    lagged = [f"w{k}" for k in range(1, len(cuts))]
    return steps.where("t >= 1").select(*cell, *_MOMENT, *lagged)


def _points(cuts: list[str]) -> list:
    """Of a step in a list: what it looks back on beyond one moment is in the steps before it."""
    return [*_MOMENT, *[F.col(f"w{k}")[0].alias(f"w{k}") for k in range(1, len(cuts))]]


def gathered_steps(steps: DataFrame, cuts: list[str], keys: list[str]) -> DataFrame:
    """``(keys, steps)``: the steps of whole series as a list each, for models with ``cuts``."""
    return _rows(steps, cuts, keys).groupBy(*keys).agg(F.collect_list(F.struct(*_points(cuts))).alias("steps"))


def _whole_series(steps, population, sets, consequent, rate_divisor, slices, keys=("key",)) -> DataFrame:
    cuts = cut_columns(population)
    others = [c for c in population.columns if c not in (*_WHO, *cuts)]
    columns = [*_WHO, *cuts, *others]
    people = checked_models(population, sets, others)
    if "steps" in steps.columns:
        listed = steps.where("key is not null")
        lagged = [f"array(w{k}) as w{k}" for k in range(1, len(cuts))]
        rows = steps.where("key is null").selectExpr(*keys, "inline(steps)").selectExpr(*keys, *_MOMENT, *lagged)
    else:
        listed, rows = None, _rows(steps, cuts, list(keys))
    columns = [c for c in columns if c not in keys[1:]]
    kinds = [f"{c} {population.schema[c].dataType.simpleString()}" for c in columns]
    schema = ", ".join([*kinds, "fitness double"])
    if slices > 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        keys = [*keys, "slice"]
        rows, listed = rows.withColumn("slice", every), listed and listed.withColumn("slice", every)
        people = people.withColumn("slice", F.pmod(F.col("ind"), F.lit(slices)))
    member = [c for c in people.columns if c not in keys]

    def score(batches):
        for batch in batches:
            yield _scored(batch, columns, cuts, sets.radix, consequent, rate_divisor)

    def score_one(series: pa.Table, members: pa.Table) -> pa.Table:
        fitness = _score(series, members, cuts, sets.radix, consequent, rate_divisor)
        return members.select(columns).append_column("fitness", fitness)

    def gathered(table, entry, name):
        return table.where("key is not null").groupBy(*keys).agg(F.collect_list(F.struct(*entry)).alias(name))

    if listed is None:
        listed = gathered(rows, _points(cuts), "steps")
    met = gathered(people, member, "members").join(listed, list(keys), "left")
    # a join drops NULL keys, a grouping does not
    nameless = rows.where("key is null").groupBy(*keys).cogroup(people.where("key is null").groupBy(*keys))
    return met.select("key", "members", "steps").mapInArrow(score, schema).union(nameless.applyInArrow(score_one, schema))


def batch_scores(train, test, models, sets: Sets, consequent: str, rate_divisor: float) -> DataFrame:
    """``(key, ids, rmse)`` of models whose rules are mined from the steps ``train`` and
    forecast the steps ``test``, for series that are a cell each. The first two steps are
    exact; fewer than two give NULL."""
    cuts, ids = cut_columns(models), model_ids(models)
    # entries that are NULL are no part of a list
    steps = F.collect_list(F.when(F.col("t") >= 1, F.struct(*_points(cuts))))
    people = checked_models(models, sets).groupBy("key").agg(F.collect_list(F.struct(*ids, *cuts)).alias("members"))
    exact = [F.expr(f"{x} as {name}") for x, name in (
        ("count(*)", "n_rows"), ("count_if(t < 2 and actual is not null)", "n_exact"),
        ("coalesce(sum(if(t < 2, actual - actual, null)), 0D)", "exact"))]
    met = (
        people.join(train.groupBy("key").agg(steps.alias("train")), "key", "left")
        .join(test.groupBy("key").agg(steps.alias("test"), *exact), "key", "left")
    )
    others = ["n_rows", "n_exact", "exact"]

    def score(batches):
        for batch in batches:
            whose, fields = _members(batch, [*ids, *cuts])
            genes = [_matrix(fields[c]) for c in cuts] if len(whose) else []
            learned, tried = (_Series(batch.column(c), len(cuts)) for c in ("train", "test"))
            squares, n = np.zeros(len(whose)), np.zeros(len(whose), np.int64)
            for some in _shares((learned.rows + tried.rows)[whose] * len(ORDERS) * len(cuts)):
                squares[some], n[some] = _squares(
                    learned, tried, [(p[some], m[some]) for p, m in genes], whose[some], sets.radix, consequent, rate_divisor)
            named = {c: batch.column(c).take(pa.array(whose)) for c in ("key", *others)}
            yield pa.RecordBatch.from_arrays(
                [named["key"], *[fields[c] for c in ids], pa.array(squares), pa.array(n), *[named[c] for c in others]],
                names=["key", *ids, "squares", "n", *others])

    kinds = ", ".join(f"{c} {models.schema[c].dataType.simpleString()}" for c in ("key", *ids))
    errors = met.select("key", "members", "train", "test", *others).mapInArrow(
        score, f"{kinds}, squares double, n bigint, n_rows bigint, n_exact bigint, exact double")
    return errors.groupBy("key", *ids).agg(F.expr(
        "if(sum(n_rows) >= 2 and sum(n + n_exact) > 0, sqrt(sum(squares + exact) / sum(n + n_exact)), null)").alias("rmse"))


def _in_blocks(steps, moves, population, layout, sets, consequent, rate_divisor) -> DataFrame:
    cuts = cut_columns(population)
    people = checked_models(population, sets)
    rows = _rows(steps, cuts, layout.cell)
    types = [f"{c} {population.schema[c].dataType.simpleString()}" for c in _WHO]
    span = sets.radix ** max(ORDERS)

    def met(members: DataFrame):
        placed = per_cell(members, steps, layout)
        renewed = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # both sides come from the steps
        return rows.groupBy(*layout.cell).cogroup(renewed.groupBy(*layout.cell))

    def count(series: pa.Table, members: pa.Table) -> pa.Table:
        found = [(pa.array([], pa.int64()), np.empty(0, np.int64), np.empty((0, sets.price), np.int64))]
        if series.num_rows and members.num_rows:
            cell = _Cell(series, len(cuts))
            for at, genes in _rounds(cell, members, cuts):
                asked, known = _antecedents(cell, genes, sets.radix)
                distinct, counts = _counts(asked, known, _labels(*genes[0], *cell.move)[:, cell.start:], sets.radix, len(cuts) - 1)
                whose, code = np.divmod(distinct, _reach(sets.radix, len(cuts) - 1))
                found.append((pa.array(whose + at), code, counts[:, :sets.price]))
        whose = pa.concat_arrays([w for w, _, _ in found])
        code, counts = (np.concatenate([f[j] for f in found]) for j in (1, 2))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), sets.price).cast(pa.list_(pa.int64()))
        return pa.table([
            *[members[c].combine_chunks().take(whose) for c in _WHO],
            pa.array((code // span).astype(np.int32)), pa.array(code % span), lists,
        ], names=[*_WHO, "slot", "code", "counts"])

    parts = met(people).applyInArrow(count, ", ".join([*types, "slot int, code bigint, counts array<bigint>"]))
    sums = ", ".join(f"sum(counts[{j}])" for j in range(sets.price))
    counts = parts.groupBy(*_WHO, "slot", "code").agg(F.expr(f"array({sums})").alias("counts"))
    book = rule_book(counts, population, moves, sets, consequent)
    entry = F.struct((F.col("slot") * span + F.col("code")).alias("code"), "u", "d")
    # a page has at most as many entries as there are antecedents of the label limits
    pages = book.groupBy(*_WHO).agg(F.array_sort(F.collect_list(entry)).alias("page"))

    def squares(series: pa.Table, members: pa.Table) -> pa.Table:
        total, n = np.zeros(members.num_rows), np.zeros(members.num_rows, np.int64)
        if series.num_rows and members.num_rows:
            cell = _Cell(series, len(cuts))
            for at, genes in _rounds(cell, members, cuts):
                here = slice(at, at + len(genes[0][1]))
                page = members["page"].combine_chunks()[here]
                sizes = page.value_lengths().fill_null(0).to_numpy()
                code, up, down = (page.flatten().field(j).to_numpy(zero_copy_only=False) for j in range(3))
                distinct = code.astype(np.int64) + np.repeat(np.arange(len(sizes)), sizes) * _reach(sets.radix, len(cuts) - 1)
                asked, known = _antecedents(cell, genes, sets.radix)
                total[here], n[here] = _errors(cell, asked, known, distinct, up.astype(float), down.astype(float), rate_divisor)
        return pa.table([*[members[c] for c in _WHO], pa.array(total), pa.array(n)], names=[*_WHO, "squares", "n"])

    errors = met(people.join(pages, _WHO, "left")).applyInArrow(squares, ", ".join([*types, "squares double, n bigint"]))
    return errors.groupBy(*_WHO).agg(F.expr("if(sum(n) > 0, sqrt(sum(squares) / sum(n)), null)").alias("fitness"))


# -- cells and labels ------------------------------------------------------------


class _Cell:
    """Steps of a cell in time order, from t = 1 on. ``start``: the first with t >= 2, which
    have a rate before them and are forecast. Of a covariate all values that steps look
    back on are one sequence: the step in row r looks at entries r to r + 2."""

    def __init__(self, table: pa.Table, variables: int):
        table = table.sort_by("t")
        self.rows = table.num_rows
        self.start = int(np.searchsorted(table["t"].to_numpy(), 2))
        self.base, self.actual, self.move = (_doubles(table[c]) for c in ("base", "actual", "move"))
        self.past = []
        for k in range(1, variables):
            lagged = [x.reshape(-1, 3) for x in _doubles(table[f"w{k}"], flat=True)]
            self.past.append(tuple(np.concatenate([x[0, :0:-1], x[:, 0]]) for x in lagged))


def _doubles(column, flat=False):
    """Values and validity of a column, or of all entries of its lists."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.flatten() if flat else array
    return array.to_numpy(zero_copy_only=False).astype(float), array.is_valid().to_numpy(zero_copy_only=False)


def _matrix(column):
    """Ragged cut arrays padded with NaN, and their sizes."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    points = np.full((len(sizes), sizes.max()), np.nan)
    points[np.arange(points.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return points, sizes


def _rounds(cell, members, cuts):
    """(first individual, cuts and sizes per variable) of as many individuals as fit."""
    genes = [_matrix(members[c]) for c in cuts]
    each = max(1, _CELLS // ((cell.rows + 2) * len(ORDERS) * len(cuts)))
    for at in range(0, members.num_rows, each):
        yield at, [(points[at:at + each], sizes[at:at + each]) for points, sizes in genes]


def _labels(points, sizes, values, valid):
    """First cut above each value, per individual; -1 for a missing value. The label is the
    number of running maxima that aren't above the value."""
    people, n = len(sizes), len(values)
    order = np.argsort(values, kind="stable")  # NaN, above which no cut is, comes last
    place = np.searchsorted(values[order], np.maximum.accumulate(points, axis=1))
    place[np.isnan(points)] = n
    spots = place + np.arange(people)[:, None] * (n + 1)
    steps = np.bincount(spots.ravel(), minlength=people * (n + 1)).reshape(people, n + 1)
    label = np.empty((people, n), np.int64)
    label[:, order] = np.cumsum(steps[:, :n], axis=1)
    label[:, ~valid] = -1
    return label


def _reach(radix, covariates):
    """Numbers that an individual's antecedents take: slot, then labels as digits."""
    return covariates * len(ORDERS) * radix ** max(ORDERS)


def _antecedents(cell, genes, radix):
    """(people, forecast steps, terms): the antecedents, with the individual in front, and
    whether all their labels are known."""
    people, steps = len(genes[0][1]), cell.rows - cell.start
    asked = np.empty((people, steps, len(cell.past) * len(ORDERS)), np.int64)
    known = np.empty(asked.shape, bool)
    for k, (values, valid) in enumerate(cell.past):
        label = _labels(*genes[k + 1], values, valid)
        ago = [label[:, 2 - d + cell.start:2 - d + cell.rows] for d in range(max(ORDERS))]
        for order in ORDERS:
            code, sound = ago[order - 1], ago[order - 1] >= 0
            for d in range(order - 2, -1, -1):
                code, sound = code * radix + ago[d], sound & (ago[d] >= 0)
            slot = k * len(ORDERS) + order - 1
            asked[..., slot], known[..., slot] = code + slot * radix ** max(ORDERS), sound
    asked += (np.arange(people) * _reach(radix, len(cell.past)))[:, None, None]
    return asked, known


def _counts(asked, known, target, radix, covariates):
    """The distinct antecedents, and how often each label followed."""
    counted = known & (target >= 0)[..., None]
    following = np.broadcast_to(target[..., None], counted.shape)[counted]
    distinct, which = np.unique(asked[counted], return_inverse=True)
    counts = np.bincount(which * radix + following, minlength=len(distinct) * radix)
    return distinct, counts.reshape(-1, radix)


def _errors(cell, asked, known, distinct, up, down, divisor):
    """Sum and number of squared errors per individual; ``up`` and ``down`` are the weighted
    midpoints and weights of the ``distinct`` antecedents."""
    people, n = asked.shape[:2]
    wanted = asked[known]
    at = np.minimum(np.searchsorted(distinct, wanted), max(len(distinct) - 1, 0))
    hit = distinct[at] == wanted if len(distinct) else np.zeros(len(wanted), bool)
    step = np.broadcast_to(np.arange(people * n).reshape(people, n, 1), known.shape)[known][hit]
    ups = np.bincount(step, up[at[hit]], people * n).reshape(people, n)
    downs = np.bincount(step, down[at[hit]], people * n).reshape(people, n)
    rate = np.divide(ups, downs, out=np.zeros(ups.shape), where=downs > 0)
    usable = cell.base[1][cell.start:] & cell.actual[1][cell.start:]
    error = (cell.base[0][cell.start:] * (1 + rate / divisor) - cell.actual[0][cell.start:])[:, usable]
    return (error**2).sum(1), int(usable.sum())


# -- whole series -----------------------------------------------------------------


def _scored(batch, columns, cuts, radix, consequent, divisor):
    """The members of a batch with their fitness. A row holds a series and its members."""
    whose, fields = _members(batch, [c for c in columns if c != "key"])
    fields = {c: batch.column("key").take(pa.array(whose)) if c == "key" else fields[c] for c in columns}
    series = _Series(batch.column("steps"), len(cuts))
    fitness = _fitness(series, whose, fields, cuts, radix, consequent, divisor)
    return pa.RecordBatch.from_arrays([*fields.values(), fitness], names=[*columns, "fitness"])


def _members(batch, columns):
    """Of all members of a batch: the row that each is in, and their ``columns``."""
    members = batch.column("members")
    sizes = members.value_lengths().fill_null(0).to_numpy()
    flat = members.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), {c: flat.field(c) for c in columns}


def _score(steps, members, cuts, radix, consequent, divisor) -> pa.Array:
    """Fitness of the members of one series."""
    columns = [steps[c] for c in _MOMENT] + [pc.list_element(steps[f"w{k}"], 0) for k in range(1, len(cuts))]
    moments = pa.StructArray.from_arrays(
        [c.combine_chunks() for c in columns], [*_MOMENT, *[f"w{k}" for k in range(1, len(cuts))]]
    )
    series = _Series(pa.ListArray.from_arrays(pa.array([0, len(moments)], pa.int32()), moments), len(cuts))
    fields = {c: members[c] for c in members.column_names}
    whose = np.zeros(members.num_rows, np.int64)
    return _fitness(series, whose, fields, cuts, radix, consequent, divisor)


def _fitness(series, whose, fields, cuts, radix, consequent, divisor) -> pa.Array:
    """Of each individual, whose columns are ``fields``, on the series ``whose``."""
    if not len(whose):
        return pa.nulls(0, pa.float64())
    genes = [_matrix(fields[c]) for c in cuts]
    first, same = _alike(whose, genes)
    once = np.full(len(first), np.nan)
    if "known" in fields:
        known, valid = _doubles(fields["known"])
        once[same[valid]] = known[valid]
    todo = np.flatnonzero(np.isnan(once))
    for some in _shares(series.rows[whose[first[todo]]] * len(ORDERS) * len(cuts)):
        at = first[todo[some]]
        once[todo[some]] = _round(series, [(p[at], n[at]) for p, n in genes], whose[at], radix, consequent, divisor)
    fitness = once[same]
    return pa.array(fitness, mask=np.isneginf(fitness))


class _Series:
    """The steps of many series, one series behind the other, each in time order."""

    def __init__(self, lists, variables: int):
        self.rows = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.rows) - self.rows
        flat = lists.flatten()
        t = flat.field("t").to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(len(self.rows)), self.rows)
        order = slice(None)
        if np.any((t[1:] < t[:-1]) & (whose[1:] == whose[:-1])):
            order = np.lexsort((t, whose))
        self.late = t[order] >= 2  # with a rate before them, so forecast

        def column(name):
            values, valid = _doubles(flat.field(name))
            return values[order], valid[order]

        self.base, self.actual, self.move = column("base"), column("actual"), column("move")
        self.past = [column(f"w{k}") for k in range(1, variables)]


def _alike(whose, genes):
    """The first of all members of a series with equal cuts, and the place of each among these."""
    wide = np.hstack([np.nan_to_num(points, nan=np.inf) for points, _ in genes])
    seen, first, same = {}, [], np.empty(len(whose), np.int64)
    for j, who in enumerate(zip(whose.tolist(), map(bytes, wide))):
        same[j] = seen.setdefault(who, len(first))
        if same[j] == len(first):
            first.append(j)
    return np.array(first), same


def _shares(cells):
    """Runs of places that hold ``_CELLS`` in all, or one place each."""
    begin, held = 0, 0
    for j, n in enumerate(cells.tolist()):
        if held + n > _CELLS and j > begin:
            yield np.arange(begin, j)
            begin, held = j, 0
        held += n
    if begin < len(cells):
        yield np.arange(begin, len(cells))


def _first_above(points, rows, values, valid):
    """:func:`_labels` for ``rows`` values of each individual, one behind the other."""
    highest = np.maximum.accumulate(points, axis=1)
    values = np.where(np.isnan(values), np.inf, values)
    label = np.zeros(len(values), np.int16)
    for j in range(points.shape[1]):
        label += np.repeat(highest[:, j], rows) <= values
    label[~valid] = -1
    return label


def _round(series, genes, whose, radix, consequent, divisor):
    """Fitness of individuals of the series ``whose``; -inf without a usable step."""
    squares, n = _squares(series, series, genes, whose, radix, consequent, divisor)
    return np.where(n > 0, np.sqrt(squares / np.maximum(n, 1)), -np.inf)


class _Asked:
    """An entry per individual and step: the individual ``who``, the ``place`` of the step in its
    series, its row ``at`` in ``series`` and the label ``price`` of its rate. ``codes`` has per
    covariate the labels of the last three moments as digits in base radix + 1, the latest first
    and radix for an unknown one, in front of them the individual and the covariate."""

    def __init__(self, series, genes, whose, radix):
        people, covariates, base = len(whose), len(genes) - 1, radix + 1
        rows = series.rows[whose]
        begin = np.cumsum(rows) - rows
        self.who = np.repeat(np.arange(people), rows)
        self.place = np.arange(len(self.who)) - np.repeat(begin, rows)
        self.at = self.place + np.repeat(series.begin[whose], rows)
        self.price = _first_above(genes[0][0], rows, series.move[0][self.at], series.move[1][self.at])
        self.late = series.late[self.at]
        young = [self.place < d for d in range(1, max(ORDERS))]
        self.codes = []
        for k, (values, valid) in enumerate(series.past):
            label = _first_above(genes[k + 1][0], rows, values[self.at], valid[self.at])
            label[label < 0] = radix
            code = (self.who * covariates + k) * base + label
            for d, early in enumerate(young, 1):
                ago = np.full(len(label), radix, np.int16)
                ago[d:] = label[:len(label) - d]
                ago[early] = radix
                code = code * base + ago
            self.codes.append(code)


def _squares(train, test, genes, whose, radix, consequent, divisor):
    """Sum and number of squared errors on ``test`` of individuals of the series ``whose``,
    with the rules of ``train`` (which may be the same).

    Entries are sorted by their codes, so equal antecedents of every order are contiguous, and
    each group is summed where it lies: a rule's weighted midpoints are the sum over its
    occurrences of the midpoints that the consequent counts for (see :class:`_Weights`)."""
    people, covariates = len(whose), len(genes) - 1
    learned = _Asked(train, genes, whose, radix)
    tried = learned if test is train else _Asked(test, genes, whose, radix)
    weights = _Weights(genes[0], tried, consequent)

    n = len(learned.who)
    known = np.flatnonzero(learned.late)
    code, entry = _sorted(np.concatenate([c[known] for c in learned.codes]), np.tile(known, covariates), n)
    ups, downs = np.zeros(len(tried.who)), np.zeros(len(tried.who))
    here = [np.zeros(len(code)), np.zeros(len(code))] if test is train else []
    sums = weights.of_entries(learned.who[entry], learned.price[entry])
    for order in ORDERS if len(code) else ():
        unit = (radix + 1) ** (max(ORDERS) - order)
        rule = code // unit
        begin = np.flatnonzero(np.concatenate([[True], rule[1:] != rule[:-1]]))
        sizes = np.diff(begin, append=len(rule))
        rules = rule[begin]
        # of the moments that the order looks back on none may be unknown
        sound = np.all([rules // (radix + 1) ** d % (radix + 1) < radix for d in range(order)], axis=0)
        found = [np.where(sound, x, 0) for x in sums(begin, sizes)]
        if test is train:
            for total, x in zip(here, found):
                total += np.repeat(x, sizes)
            continue
        for asked in tried.codes:
            wanted = asked // unit
            place = np.minimum(np.searchsorted(rules, wanted), len(rules) - 1)
            hit = np.flatnonzero((rules[place] == wanted) & tried.late)
            ups[hit] += found[0][place[hit]]
            downs[hit] += found[1][place[hit]]
    if test is train:
        ups, downs = (np.bincount(entry, x, n) for x in here)
    rate = np.divide(ups, downs, out=np.zeros(len(ups)), where=downs > 0)
    at, who = tried.at, tried.who
    usable = tried.late & test.base[1][at] & test.actual[1][at]
    error = (test.base[0][at] * (1 + rate / divisor) - test.actual[0][at])[usable]
    return np.bincount(who[usable], error**2, people), np.bincount(who[usable], minlength=people)


def _sorted(code, entry, n):
    """``code`` in order, and ``entry`` (below ``n``) with it. Sorting the two as one number is
    several times faster than finding the order of one."""
    bits = max(n.bit_length(), 1)
    if not len(code) or int(code.max()).bit_length() + bits > 63:
        order = np.argsort(code, kind="stable")
        return code[order], entry[order]
    both = np.sort(code << bits | entry)
    return both >> bits, both & ((1 << bits) - 1)


class _Weights:
    """What the entries of a group add to its weighted midpoints and to its weight.

    ``by_position`` counts consequent F[j] for midpoint j, if label j was seen in the group; so
    an entry with label c adds those midpoints j that have F[j] = c and whose label was
    seen. Both are sets of bits, in words of ``WORD`` places; the sum over a set is looked up
    in two tables of its halves."""

    WORD, HALF = 10, 5

    def __init__(self, price_genes, tried, consequent):
        points, sizes = price_genes
        people, self.width = len(sizes), points.shape[1] + 1
        self.consequent, self.mids = consequent, _midpoints(points, sizes)
        if consequent == "by_label":
            return
        head = np.full((people, self.width), -1)
        early = tried.place < self.width
        head[tried.who[early], tried.place[early]] = tried.price[early]
        head[np.arange(self.width) > sizes[:, None]] = -1  # no such midpoint
        j = np.arange(self.width)
        #: [word][individual, label]: the places j with F[j] = label
        self.places = np.zeros((-(-self.width // self.WORD), people, self.width), np.int16)
        person, place = np.nonzero(head >= 0)
        np.bitwise_or.at(self.places, (place // self.WORD, person, head[person, place]), (1 << place % self.WORD).astype(np.int16))
        #: [word][individual, half, set]
        self.tables = []
        for word in range(len(self.places)):
            table = np.zeros((people, 2, 1 << self.HALF))
            for j in range(word * self.WORD, min(self.width, (word + 1) * self.WORD)):
                half, bit = divmod(j % self.WORD, self.HALF)
                table[:, half, 1 << bit:2 << bit] = table[:, half, :1 << bit] + self.mids[:, j, None]
            self.tables.append(table.reshape(-1))
        self.sizes = np.array([m.bit_count() for m in range(1 << self.WORD)], float)

    def of_entries(self, who, price):
        """A function of groups of entries (where they begin, their sizes) that gives both sums."""
        counted = price >= 0
        label = np.maximum(price, 0)
        if self.consequent == "by_label":
            up, down = np.where(counted, self.mids[who, label], 0), counted.astype(float)
            return lambda begin, sizes: (np.add.reduceat(up, begin), np.add.reduceat(down, begin))
        words = range(len(self.places))
        own = [np.where(counted, self.places[word][who, label], 0).astype(np.int16) for word in words]
        seen = [np.where(counted & (label // self.WORD == word), 1 << label % self.WORD, 0).astype(np.int16) for word in words]
        corner = who << self.HALF + 1

        def sums(begin, sizes):
            up, down = 0, 0
            for word in words:
                some = own[word]
                if self.consequent == "by_position":
                    some = some & np.repeat(np.bitwise_or.reduceat(seen[word], begin), sizes)
                low, high = some & (1 << self.HALF) - 1, (some >> self.HALF) + (1 << self.HALF)
                table = self.tables[word]
                up = up + (table[corner + low] + table[corner + high])
                down = down + self.sizes[some]
            return np.add.reduceat(up, begin), np.add.reduceat(down, begin)

        return sums


def _midpoints(points, sizes):
    mids = np.zeros((len(sizes), points.shape[1] + 1))
    mids[:, 1:-1] = (points[:, 1:] + points[:, :-1]) / 2
    mids[:, 0] = points[:, 0] - EDGE_OFFSET
    rows = np.arange(len(sizes))
    mids[rows, sizes] = points[rows, sizes - 1] + EDGE_OFFSET
    return np.nan_to_num(mids)
