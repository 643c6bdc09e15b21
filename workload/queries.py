"""Every operator as a query over the given tables.

Observations: each line item is an observation of its supplier, the series key is
``supplier/year of shipment``. The number of series grows with the data. Months 1
to 10 are the training part of a series, months 11 and 12 the test part, in the queries
that score a hold-out; the others take whole series.

The queries named ``..._blocks`` have a fixed number of series instead, whose length grows
with the data, and cut them into blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rulecast.operators import forecast as fc
from rulecast.operators import population as po
from rulecast.operators import predicates as pr
from rulecast.operators import rules as ru
from rulecast.operators import series as se
from rulecast.operators.layout import SeriesLayout, grow_blocks, measure_layout
from rulecast.plans import scoring, training
from rulecast.settle import scratch_path, settle
from rulecast.sources import observations as src
from rulecast.sources import store

#: One uniform model per series.
UNIFORM = po.Search(population=2, elite=1, tournament=1)
#: Two independent random models per series.
RANDOM = po.Search(repeats=2, population=2, elite=1, tournament=1, init="random", seed=11)
#: A small population, with mutation frequent enough to be seen.
SMALL = po.Search(
    population=7, elite=2, tournament=3, init="random", mutation_rate=0.4, generations=2, seed=5
)
#: Room for two children of each of its individuals.
CROSSING = replace(SMALL, population=SMALL.elite + 2 * SMALL.population)
VARIABLES = 5
CUTS = [f"c{k}" for k in range(VARIABLES)]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


SHORT_KEY = "concat_ws('/', string(l_suppkey), string(year(l_shipdate)))"
LONG_KEY = "string(l_suppkey % 50)"
FLAG_KEY = "l_returnflag"  # three series, each longer than an Arrow batch
VALUES = ("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
#: Of long series.
BLOCKS = SeriesLayout(block_rows=250)


def observations(spark: SparkSession, sf_dir: str, key: str = SHORT_KEY) -> DataFrame:
    keyed = lineitem(spark, sf_dir).selectExpr(f"{key} as symbol", "l_shipdate", *VALUES)
    return src.to_series_form(keyed, "l_shipdate", "symbol", VALUES)


def _layout(obs: DataFrame, long: bool) -> SeriesLayout:
    return grow_blocks(BLOCKS, obs) if long else measure_layout(obs)


def parts(spark: SparkSession, sf_dir: str, long: bool = False) -> tuple[DataFrame, DataFrame, SeriesLayout]:
    """Indexed train and test series, each used several times by a plan."""
    obs = observations(spark, sf_dir, LONG_KEY if long else SHORT_KEY)
    layout = _layout(obs, long)
    train = se.index_series(obs.where("month(ts) <= 10"), layout)
    test = se.index_series(obs.where("month(ts) > 10"), layout)
    return settle(train), settle(test), layout


def train_part(spark: SparkSession, sf_dir: str, long: bool = False) -> tuple[DataFrame, SeriesLayout]:
    """The whole table, where nothing is scored on a hold-out."""
    series, layout = whole(spark, sf_dir, long)
    return settle(series), layout


def whole(spark: SparkSession, sf_dir: str, long: bool = False) -> tuple[DataFrame, SeriesLayout]:
    obs = observations(spark, sf_dir, LONG_KEY if long else SHORT_KEY)
    layout = _layout(obs, long)
    return se.index_series(obs, layout), layout


def models_for(train: DataFrame, layout: SeriesLayout, search: po.Search) -> DataFrame:
    ranges = se.series_range(train, layout)
    first = po.init_population(ranges, search, VARIABLES).where("ind = 0")
    return settle(first.select("key", "model", *CUTS))


def listed_cuts(df: DataFrame, *ids: str) -> DataFrame:
    """One row per cut point, for comparison."""
    entries = ", ".join(f"struct({k} as var, {c} as cuts)" for k, c in enumerate(ru.cut_columns(df)))
    return df.selectExpr(*ids, f"inline(array({entries}))").selectExpr(
        *ids, "var", "posexplode(cuts) as (pos, cut)"
    ).selectExpr(*ids, "var", "pos", "round(cut, 9) as cut")


def _derive_series_key(spark, sf_dir):
    table = lineitem(spark, sf_dir).selectExpr(
        "string(l_suppkey) as folder",
        "concat_ws('/', year(l_shipdate), month(l_shipdate), day(l_shipdate)) as token",
    )
    keyed = table.select(src.derive_series_key(table["folder"], table["token"]).alias("key"))
    return keyed.groupBy("key").count().withColumnRenamed("count", "n")


def _written(spark, sf_dir) -> str:
    path = scratch_path(spark, "observations")
    rows = lineitem(spark, sf_dir).selectExpr(
        "string(l_suppkey) as folder", "l_shipdate as ts", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "double(l_linenumber) as l_linenumber",
    )
    values = ("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    src.write_observations(rows, path, values)
    return path


def _read_observations(spark, sf_dir):
    return src.read_observations(spark, _written(spark, sf_dir))


def _read_folders(spark, sf_dir):
    """Two instruments of all; the folders of the others are not opened."""
    return src.read_observations(spark, _written(spark, sf_dir), folders=["3", "7"])


def _index_series(spark, sf_dir, long=False):
    return whole(spark, sf_dir, long)[0]


def _series_keys(spark, sf_dir):
    return se.series_keys(whole(spark, sf_dir)[0])


def _model_keys(spark, sf_dir):
    return se.model_keys(_init(RANDOM, po.init_cuts_random, spark, sf_dir))


def _find_series(spark, sf_dir):
    return se.find_series(whole(spark, sf_dir)[0], "1/1998")


def _stored_series(spark, sf_dir):
    """Every series is stored, then one is read."""
    path = scratch_path(spark, "series")
    store.write_series(whole(spark, sf_dir)[0], path)
    return store.stored_series(store.open_series(spark, path), "1/1998")


FALLING = "v0 < before_v0"


def _filter_by_run(spark, sf_dir):
    """Series whose price falls six times in a row, over the edges of small blocks."""
    series = whole(spark, sf_dir)[0]
    return pr.filter_by_run(series, FALLING, 6, SeriesLayout(block_rows=16)).select("key", "i", "v0")


def _longest_run(long, spark, sf_dir):
    series, layout = whole(spark, sf_dir, long)
    return pr.longest_run(series, FALLING, layout)


def _filter_exists(spark, sf_dir):
    return pr.filter_exists(whole(spark, sf_dir)[0], "v0 > 104000 and v1 = 50").select("key", "i", "v0")


def _filter_forall(spark, sf_dir):
    return pr.filter_forall(whole(spark, sf_dir)[0], "v0 > 1000").select("key", "i", "v0")


def _filter_series(spark, sf_dir):
    from pyspark.sql import functions as F

    return se.filter_series(whole(spark, sf_dir)[0], F.max("v0") > 104000).select("key", "i", "v0")


def _points(assembled: DataFrame, columns: str) -> DataFrame:
    return assembled.selectExpr("key", "block", f"posexplode(series) as ({columns})")


def _assemble_by_time(spark, sf_dir):
    series, layout = whole(spark, sf_dir)
    points = _points(se.assemble_by_time(series, layout), "i, x")
    return points.selectExpr("key", "i", *[f"x[{k}] as v{k}" for k in range(VARIABLES)])


def _assemble_by_var(spark, sf_dir):
    series, layout = whole(spark, sf_dir)
    rows = _points(se.assemble_by_var(series, layout), "var, x")
    return rows.selectExpr("key", "var", "posexplode(x) as (i, value)")


def _transpose_series(spark, sf_dir):
    series, layout = whole(spark, sf_dir)
    rows = _points(se.transpose_series(se.assemble_by_time(series, layout)), "var, x")
    return rows.selectExpr("key", "var", "size(x) as n", "round(aggregate(x, 0D, (a, v) -> a + v), 4) as total")


def _series_range(spark, sf_dir):
    series, layout = whole(spark, sf_dir)
    return se.series_range(series, layout).selectExpr(
        "key", "inline(zip_with(lo, hi, (l, h) -> struct(l as lo, h as hi)))"
    )


def _series_stats(spark, sf_dir):
    stats = se.series_stats(whole(spark, sf_dir)[0])
    return stats.selectExpr("key", "n", *[f"round({c}, 6) as {c}" for c in stats.columns[2:]])


def _change_rate(spark, sf_dir):
    series, layout = whole(spark, sf_dir)
    return se.change_rate(series, layout).selectExpr("key", "i", "round(rate, 9) as rate")


def _init(search: po.Search, start, spark, sf_dir):
    train, layout = train_part(spark, sf_dir)
    population = start(se.series_range(train, layout), search, VARIABLES)
    return listed_cuts(population, "key", "model", "ind")


def _discretize(spark, sf_dir):
    train, layout = train_part(spark, sf_dir)
    return ru.discretize(train, models_for(train, layout, UNIFORM), layout)


def _align_covariates(spark, sf_dir):
    return ru.align_covariates(_discretize(spark, sf_dir))


def _interval_midpoints(spark, sf_dir):
    from rulecast.functions.intervals import interval_midpoints

    train, layout = train_part(spark, sf_dir)
    models = models_for(train, layout, RANDOM)
    return models.selectExpr("key", "model", f"posexplode({interval_midpoints('c0')}) as (j, mid)").selectExpr(
        "key", "model", "j", "round(mid, 9) as mid"
    )


def _shown(rules: DataFrame) -> DataFrame:
    return rules.selectExpr(
        "key", "model", "var", "ord", "array_join(antecedent, '-') as antecedent", "consequent", "n"
    )


def _rules(var: int, order: int, spark, sf_dir):
    train, layout = train_part(spark, sf_dir)
    return _shown(ru.mine_rules(train, models_for(train, layout, UNIFORM), var, order, layout))


def _mine_all_rules(spark, sf_dir, long=False):
    train, layout = train_part(spark, sf_dir, long)
    return _shown(ru.mine_all_rules(train, models_for(train, layout, UNIFORM), layout))


#: The rules that a forecaster looks up; no others are mined for it.
RULES_OF = {
    fc.forecast_multiorder: ru.covariate_terms,
    fc.forecast_by_variable: ru.covariate_terms,
    fc.forecast_multivar: fc.first_terms,
    fc.forecast_uni: fc.price_terms,
}


def _forecast(operator, spark, sf_dir, long=False, **options):
    train, test, layout = parts(spark, sf_dir, long)
    models = models_for(train, layout, UNIFORM)
    rules = ru.antecedent_counts(ru.forecast_steps(train, layout), models, RULES_OF[operator](models), layout)
    return operator(test, rules, models, layout=layout, **options)


def _rates(forecast: DataFrame) -> DataFrame:
    return forecast.where("t >= 2").selectExpr("key", "model", "t", "round(rate, 7) as rate")


def _forecast_multiorder(spark, sf_dir, **options):
    return _rates(_forecast(fc.forecast_multiorder, spark, sf_dir, **options))


def _forecast_by_variable(spark, sf_dir):
    out = _forecast(fc.forecast_by_variable, spark, sf_dir)
    return out.where("t >= 2").selectExpr("key", "model", "var", "t", "round(rate, 7) as rate")


def _forecast_multivar(spark, sf_dir):
    return _rates(_forecast(fc.forecast_multivar, spark, sf_dir))


def _forecast_uni(spark, sf_dir):
    return _rates(_forecast(fc.forecast_uni, spark, sf_dir))


def _price(keep_head: bool, divisor: float, spark, sf_dir):
    priced = fc.price_from_rate(
        _forecast(fc.forecast_multiorder, spark, sf_dir), divisor, keep_head
    )
    return priced.selectExpr("key", "model", "t", "actual", "round(price_hat, 4) as price_hat")


def _rmse_train(spark, sf_dir):
    train, layout = train_part(spark, sf_dir)
    models = models_for(train, layout, UNIFORM)
    rules = ru.antecedent_counts(ru.forecast_steps(train, layout), models, ru.covariate_terms(models), layout)
    forecast = fc.forecast_multiorder(train, rules, models, aligned=True, layout=layout)
    return fc.rmse(fc.price_from_rate(forecast)).selectExpr("key", "model", "round(rmse, 4) as rmse")


def _rmse_test(spark, sf_dir):
    forecast = _forecast(fc.forecast_multiorder, spark, sf_dir)
    scored = fc.rmse(fc.price_from_rate(forecast, keep_head=True))
    return scored.selectExpr("key", "model", "round(rmse, 4) as rmse")


def _scores(spark, sf_dir, long=False, **options):
    train, test, layout = parts(spark, sf_dir, long)
    return scoring.score_models(train, test, models_for(train, layout, RANDOM), layout, **options)


def score_models(spark, sf_dir, **options):
    return _scores(spark, sf_dir, **options).selectExpr("key", "model", "round(rmse, 4) as rmse")


def _mean_score(spark, sf_dir):
    return scoring.mean_score(_scores(spark, sf_dir)).selectExpr("key", "round(rmse, 4) as rmse")


def _report_sorted(spark, sf_dir):
    means = scoring.mean_score(_scores(spark, sf_dir))
    return scoring.report_sorted(means).selectExpr("key", "round(rmse, 4) as rmse")


def _report_slice_mean(spark, sf_dir):
    report = scoring.report_slice_mean(scoring.mean_score(_scores(spark, sf_dir)))
    return report.selectExpr("round(slice_mean, 4) as slice_mean")


def _write_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scoring.write_scores(scoring.mean_score(_scores(spark, sf_dir)), path)
    return spark.read.parquet(path).selectExpr("key", "round(rmse, 4) as rmse")


def scored_population(spark, sf_dir, search: po.Search = SMALL, strategy: str = "batch", long: bool = False) -> DataFrame:
    train, layout = train_part(spark, sf_dir, long)
    population = settle(po.init_population(se.series_range(train, layout), search, VARIABLES))
    return training.evaluate_population(train, population, layout, search.sets, strategy)


def evaluate(strategy: str, spark, sf_dir, search: po.Search = SMALL, long: bool = False):
    scored = scored_population(spark, sf_dir, search, strategy, long)
    return scored.selectExpr("key", "model", "ind", "round(fitness, 4) as fitness")


def _select_elite(spark, sf_dir):
    best = po.select_elite(scored_population(spark, sf_dir), SMALL.elite)
    return best.selectExpr("key", "model", "ind", "rank", "round(fitness, 4) as fitness")


def _tournament_select(spark, sf_dir):
    return po.tournament_select(scored_population(spark, sf_dir), SMALL)


def _single_point_crossover(spark, sf_dir):
    """Every individual of a series crossed with the next one."""
    train, layout = train_part(spark, sf_dir)
    population = po.init_population(se.series_range(train, layout), SMALL, VARIABLES)
    genes = _expr(f"array_sort(collect_list(struct(ind, {', '.join(CUTS)})))", "pool")
    couples = population.groupBy("key", "model").agg(genes).selectExpr(
        "key", "model", "pool", "posexplode(pool) as (pair, a)"
    ).selectExpr("key", "model", "pair", "a", "pool[(pair + 1) % size(pool)] as b")
    return listed_cuts(po.single_point_crossover(couples, CROSSING), "key", "model", "ind")


def _expr(text: str, name: str):
    from pyspark.sql import functions as F

    return F.expr(text).alias(name)


def _children(spark, sf_dir) -> DataFrame:
    return po.crossover_population(scored_population(spark, sf_dir), SMALL)


def _crossover_population(spark, sf_dir):
    return listed_cuts(_children(spark, sf_dir), "key", "model", "ind")


def _random_population(spark, sf_dir) -> DataFrame:
    train, layout = train_part(spark, sf_dir)
    return po.init_population(se.series_range(train, layout), SMALL, VARIABLES)


def _mutate_population(spark, sf_dir):
    mutated = po.mutate_population(_random_population(spark, sf_dir), SMALL)
    return listed_cuts(mutated, "key", "model", "ind")


def _repair(mode: str, spark, sf_dir):
    return listed_cuts(po.repair_cuts(_children(spark, sf_dir), mode), "key", "model", "ind")


def _trim_cuts(spark, sf_dir):
    return listed_cuts(po.trim_cuts(_children(spark, sf_dir), SMALL), "key", "model", "ind")


def next_generation(spark, sf_dir, search: po.Search = SMALL):
    bred = po.next_generation(scored_population(spark, sf_dir, search), search, 0)
    return listed_cuts(bred, "key", "model", "ind")


def fit_cuts(spark, sf_dir, search: po.Search = SMALL, strategy: str = "batch", layout: SeriesLayout | None = None):
    train, measured = train_part(spark, sf_dir)
    blocks = layout and grow_blocks(layout, lineitem(spark, sf_dir))
    models = training.fit_cuts(train, search, blocks or measured, strategy)
    return listed_models(models)


def listed_models(models: DataFrame) -> DataFrame:
    named = models.selectExpr("*", "round(fitness, 4) as score")
    ids = ("key", "model", "score", "max_price_set", "max_item_set")
    return listed_cuts(named, *ids).withColumnRenamed("score", "fitness")


def _train_series(spark, sf_dir):
    train, layout = train_part(spark, sf_dir)
    return listed_models(training.train_series(train, layout=layout, search=SMALL))


def _train_series_price(spark, sf_dir):
    """The price alone."""
    train, layout = train_part(spark, sf_dir)
    return listed_models(training.train_series(train, values=["v0"], layout=layout, search=SMALL))


def _train_series_custom(spark, sf_dir):
    """A trainer of the user's own, from a series table to a model table."""
    train, layout = train_part(spark, sf_dir)
    models = training.train_series(train, lambda series: models_for(series, layout, UNIFORM))
    return listed_cuts(models, "key", "model")


def _train_series_with(spark, sf_dir):
    """A Python trainer that gets each short series as a pandas table."""
    train, layout = train_part(spark, sf_dir)

    def cuts(rows):
        ends = rows[["v1", "v2"]].agg(["min", "max"])
        return rows[["key"]].head(1).assign(
            model=1, c0=[[0.0]], **{f"c{k}": [[ends[f"v{k}"]["min"], ends[f"v{k}"]["max"]]] for k in (1, 2)})

    schema = "key string, model int, c0 array<double>, c1 array<double>, c2 array<double>"
    return listed_cuts(training.train_series_with(train, cuts, schema, layout), "key", "model")


def _train_series_streamed(spark, sf_dir):
    """A Python trainer with a running state, over series that are longer than a batch:
    uniform cuts between the extremes of the rates and of each covariate."""
    series = se.index_series(observations(spark, sf_dir, FLAG_KEY))

    def uniform(key, batches):
        import numpy as np
        import pyarrow as pa

        last, low, high = np.empty(0), np.full(VARIABLES, np.inf), np.full(VARIABLES, -np.inf)
        for batch in batches:
            seen = [batch.column(f"v{k}").to_numpy() for k in range(VARIABLES)]
            price = np.concatenate([last, seen[0]])
            last, seen[0] = price[-1:], (price[1:] - price[:-1]) / price[:-1]
            for k, values in enumerate(seen):
                low[k], high[k] = values.min(initial=low[k]), values.max(initial=high[k])
        cuts = {f"c{k}": [[low[k] + (high[k] - low[k]) / 9 * j for j in range(1, 9)]] for k in range(VARIABLES)}
        yield pa.RecordBatch.from_pydict({"key": [key], "model": pa.array([1], pa.int32()), **cuts})

    schema = "key string, model int, " + ", ".join(f"{c} array<double>" for c in CUTS)
    return listed_cuts(training.train_series_streamed(series, uniform, schema), "key", "model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_observations": _read_observations,
    "read_folders": _read_folders,
    "derive_series_key": _derive_series_key,
    "index_series": _index_series,
    "series_keys": _series_keys,
    "find_series": _find_series,
    "filter_series": _filter_series,
    "assemble_by_time": _assemble_by_time,
    "assemble_by_var": _assemble_by_var,
    "transpose_series": _transpose_series,
    "series_range": _series_range,
    "series_stats": _series_stats,
    "change_rate": _change_rate,
    "init_cuts_uniform": partial(_init, UNIFORM, po.init_cuts_uniform),
    "model_keys": _model_keys,
    "init_cuts_random": partial(_init, RANDOM, po.init_cuts_random),
    "discretize": _discretize,
    "align_covariates": _align_covariates,
    "interval_midpoints": _interval_midpoints,
    "rules_uni_o1": partial(_rules, 0, 1),
    "rules_uni_o2": partial(_rules, 0, 2),
    "rules_uni_o3": partial(_rules, 0, 3),
    "rules_var_o1": partial(_rules, 1, 1),
    "rules_var_o2": partial(_rules, 1, 2),
    "rules_var_o3": partial(_rules, 1, 3),
    "mine_all_rules": _mine_all_rules,
    "forecast_uni": _forecast_uni,
    "forecast_multivar": _forecast_multivar,
    "forecast_multiorder": _forecast_multiorder,
    "forecast_multiorder_by_label": partial(_forecast_multiorder, consequent="by_label"),
    "forecast_by_variable": _forecast_by_variable,
    "price_from_rate": partial(_price, False, 100.0),
    "price_from_rate_fraction": partial(_price, False, 1.0),
    "price_from_rate_head": partial(_price, True, 100.0),
    "rmse_train": _rmse_train,
    "rmse_test": _rmse_test,
    "score_models": score_models,
    "score_models_aligned": partial(score_models, align_test=True, consequent="by_label", rate_divisor=1.0),
    "mean_score": _mean_score,
    "report_sorted": _report_sorted,
    "report_slice_mean": _report_slice_mean,
    "write_scores": _write_scores,
    "evaluate_population": partial(evaluate, "relational"),
    "evaluate_population_batch": partial(evaluate, "batch"),
    "select_elite": _select_elite,
    "tournament_select": _tournament_select,
    "single_point_crossover": _single_point_crossover,
    "crossover_population": _crossover_population,
    "mutate_population": _mutate_population,
    "repair_cuts": partial(_repair, "shrinking"),
    "repair_cuts_first": partial(_repair, "first"),
    "trim_cuts": _trim_cuts,
    "next_generation": next_generation,
    "fit_cuts": fit_cuts,
    "train_series": _train_series,
    "train_series_price": _train_series_price,
    "train_series_custom": _train_series_custom,
    "train_series_with": _train_series_with,
    "train_series_streamed": _train_series_streamed,
    "stored_series": _stored_series,
    "filter_by_run": _filter_by_run,
    "longest_run": partial(_longest_run, False),
    "filter_exists": _filter_exists,
    "filter_forall": _filter_forall,
    "index_series_blocks": partial(_index_series, long=True),
    "longest_run_blocks": partial(_longest_run, True),
    "mine_all_rules_blocks": partial(_mine_all_rules, long=True),
    "forecast_multiorder_blocks": partial(_forecast_multiorder, long=True, lookup="map"),
    "forecast_multiorder_join": partial(_forecast_multiorder, long=True, lookup="join"),
    "score_models_blocks": partial(score_models, long=True),
    "evaluate_population_blocks": partial(evaluate, "batch", long=True),
    "fit_cuts_blocks": partial(fit_cuts, layout=SeriesLayout(block_rows=32)),
}
