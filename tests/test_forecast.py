"""Rules, forecasts and scores against hand-worked cases and the plain reading."""

import datetime as dt
import random

import plain
import pytest

from rulecast.operators import forecast as fc
from rulecast.operators import rules as ru
from rulecast.operators import series as se
from rulecast.operators.layout import SeriesLayout
from rulecast.plans import batch_fitness as batch
from rulecast.plans import scoring, training

DAY = dt.datetime(2020, 1, 1)
WHOLE = SeriesLayout(whole_keys=True, longest=200)
K = 3


def make(seed, lengths):
    draw = random.Random(seed)
    return {
        key: [[round(draw.uniform(1, 3), 3) for _ in range(n)]] + [[round(draw.random(), 2) for _ in range(n)] for _ in range(K - 1)]
        for key, n in lengths.items()
    }


TRAIN = make(1, {"a": 60, "b": 35, "hot": 190, "tiny": 2, "only_train": 20})
TEST = make(2, {"a": 17, "b": 4, "hot": 50, "tiny": 12, "only_test": 9, "two": 2})
#: unsorted cuts in model 2, as a crossover may leave them
CUTS = {
    1: [[-0.3, 0.0, 0.4], [0.3, 0.6], [0.2, 0.5, 0.9]],
    2: [[0.2, -0.2, 0.5, 0.1], [0.7, 0.2, 0.4], [0.5]],
}


def table(spark, data):
    rows = [
        (key, t, DAY + dt.timedelta(days=t), *[v[t] for v in series])
        for key, series in data.items()
        for t in range(len(series[0]))
    ]
    return spark.createDataFrame(rows, f"key string, i bigint, ts timestamp_ntz, {', '.join(f'v{k} double' for k in range(K))}")


def model_table(spark, keys):
    rows = [(key, m, *cuts) for key in keys for m, cuts in CUTS.items()]
    return spark.createDataFrame(rows, f"key string, model int, {', '.join(f'c{k} array<double>' for k in range(K))}")


@pytest.fixture(scope="module")
def tables(spark):
    keys = ["a", "b", "hot", "tiny", "only_train", "only_test"]
    return table(spark, TRAIN).cache(), table(spark, TEST).cache(), model_table(spark, keys).cache()


LAYOUTS = [WHOLE, SeriesLayout(16)]


@pytest.mark.parametrize("layout", LAYOUTS, ids=["whole", "blocks"])
def test_rules(spark, tables, layout):
    train, _, models = tables
    want = set()
    for key in ("a", "b", "hot", "tiny", "only_train"):
        for m, cuts in CUTS.items():
            price, others = plain.labelled(TRAIN[key], cuts, True)
            for k, source in enumerate([price, *others]):
                for o in ru.ORDERS:
                    for (antecedent, c), n in plain.rules(source, price, o).items():
                        want.add((key, m, k, o, antecedent, c, n))
    got = ru.mine_all_rules(train, models, layout).collect()
    assert len(got) == len(want)
    assert {(r["key"], r["model"], r["var"], r["ord"], tuple(r["antecedent"]), r["consequent"], r["n"]) for r in got} == want
    single = ru.mine_rules(train, models, 2, 3, layout)
    assert single.count() == sum(1 for w in want if w[2] == 2 and w[3] == 3)


def test_rule_counts_sum_to_steps(spark, tables):
    train, _, models = tables
    sums = ru.mine_all_rules(train, models, WHOLE).where("key = 'a'").groupBy("model", "var", "ord").sum("n").collect()
    assert len(sums) == 2 * K * 3
    assert all(r["sum(n)"] == 59 - r["ord"] for r in sums)


@pytest.mark.parametrize("layout", LAYOUTS, ids=["whole", "blocks"])
@pytest.mark.parametrize("lookup", ["map", "join"])
@pytest.mark.parametrize("consequent", ["by_position", "by_label"])
def test_multiorder(spark, tables, layout, lookup, consequent):
    train, test, models = tables
    rules = ru.mine_all_rules(train, models, layout)
    got = fc.forecast_multiorder(test, rules, models, layout=layout, lookup=lookup, consequent=consequent)
    found = {(r["key"], r["model"], r["t"]): r["rate"] for r in got.where("t >= 2").collect()}
    want = {}
    for key in ("a", "b", "hot", "tiny"):
        for m, cuts in CUTS.items():
            tables_ = plain.all_tables(*reversed(plain.labelled(TRAIN[key], cuts, True)))
            price, others = plain.labelled(TEST[key], cuts, False)
            rate = plain.forecast(plain.midpoints(cuts[0]), tables_, others, price, consequent)
            want.update({(key, m, t + 2): r for t, r in enumerate(rate)})
    found = {k: v for k, v in found.items() if k[0] != "only_test"}
    assert found == pytest.approx(want, rel=1e-12)


def test_multivar_and_uni(spark, tables):
    train, test, models = tables
    rules = ru.mine_all_rules(train, models, WHOLE)
    for operator, consequent in ((fc.forecast_multivar, "by_position"), (fc.forecast_uni, "unguarded")):
        got = operator(train, rules, models, layout=WHOLE) if operator is fc.forecast_uni else operator(train, rules, models, aligned=True, layout=WHOLE)
        for key in ("a", "hot"):
            for m, cuts in CUTS.items():
                price, others = plain.labelled(TRAIN[key], cuts, True)
                sources = [price] if operator is fc.forecast_uni else [price, *others]
                firsts = [(k, 1, plain.rules(v, price, 1)) for k, v in enumerate(sources)]
                want = plain.forecast(plain.midpoints(cuts[0]), firsts, sources, price, consequent)
                rows = got.where(f"key = '{key}' and model = {m} and t >= 2").orderBy("t").collect()
                assert [r["rate"] for r in rows] == pytest.approx(want, rel=1e-12)


def test_forecasts_take_counts_of_their_own_rules(spark, tables):
    """Counted antecedents of a forecaster's terms do for a table of all rules."""
    train, test, models = tables
    rules = ru.mine_all_rules(train, models, WHOLE)
    for operator, terms in ((fc.forecast_uni, fc.price_terms), (fc.forecast_multivar, fc.first_terms), (fc.forecast_multiorder, ru.covariate_terms)):
        counts = ru.antecedent_counts(ru.forecast_steps(train, WHOLE), models, terms(models), WHOLE)
        got, want = ({(r["key"], r["model"], r["t"]): r["rate"] for r in operator(test, x, models, layout=WHOLE).where("t >= 2").collect()} for x in (counts, rules))
        assert got == pytest.approx(want, rel=1e-12) and any(got.values())


def test_uni_by_hand(spark):
    """Labels 0,1,0,1 under one cut: 0 is followed by 1 and 1 by 0."""
    prices = [1.0, 0.9, 1.8, 0.9, 1.8]
    series = spark.createDataFrame([("a", t, p) for t, p in enumerate(prices)], "key string, i bigint, v0 double")
    models = spark.createDataFrame([("a", 1, [0.0])], "key string, model int, c0 array<double>")
    rules = ru.mine_rules(series, models, 0, 1, WHOLE)
    assert {(tuple(r["antecedent"]), r["consequent"], r["n"]) for r in rules.collect()} == {((0,), 1, 2), ((1,), 0, 1)}
    rates = [r["rate"] for r in fc.forecast_uni(series, rules, models, layout=WHOLE).where("t >= 2").orderBy("t").collect()]
    assert rates == pytest.approx([0.002, -0.002, 0.002])


def test_price_and_rmse_by_hand(spark):
    rows = [("a", 1, 0, None, 10.0, None), ("a", 1, 1, 10.0, 20.0, None), ("a", 1, 2, 20.0, 30.0, 1.0), ("a", 1, 3, 30.0, 40.0, -2.0)]
    forecast = spark.createDataFrame(rows, "key string, model int, t int, base double, actual double, rate double")
    assert [r["price_hat"] for r in fc.price_from_rate(forecast).orderBy("t").collect()] == pytest.approx([20.2, 29.4])
    head = fc.price_from_rate(forecast, keep_head=True)
    assert [r["price_hat"] for r in head.orderBy("t").collect()] == pytest.approx([10, 20, 20.2, 29.4])
    rows = [("a", 1, t, p, a) for t, p, a in ((2, 2.0, 3.0), (3, 5.0, 5.0))]
    priced = spark.createDataFrame(rows, "key string, model int, t int, price_hat double, actual double")
    assert fc.rmse(priced).first()["rmse"] == pytest.approx(0.5**0.5)


@pytest.mark.parametrize("layout", LAYOUTS, ids=["whole", "blocks"])
def test_scores(spark, tables, layout):
    train, test, models = tables
    got = {(r["key"], r["model"]): r["rmse"] for r in scoring.score_models(train, test, models, layout).collect()}
    want = {(key, m): plain.score(TRAIN[key], TEST[key], cuts) for key in ("a", "b", "hot", "tiny") for m, cuts in CUTS.items()}
    assert got == pytest.approx(want, rel=1e-12)
    means = {r["key"]: r["rmse"] for r in scoring.mean_score(scoring.score_models(train, test, models, layout)).collect()}
    assert means["a"] == pytest.approx((want["a", 1] + want["a", 2]) / 2)


def test_scores_form_no_row_for_each_antecedent(spark, tables):
    """Series that a task holds are scored from lists; both strategies give the same."""
    train, test, models = tables
    got, want = (scoring.score_models(train, test, models, WHOLE, strategy=s) for s in ("batch", "relational"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (got, want)]
    assert ["posexplode" in plan for plan in plans] == [False, True]
    scores = [{(r["key"], r["model"]): r["rmse"] for r in df.collect()} for df in (got, want)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


@pytest.mark.parametrize("aligned", [False, True])
@pytest.mark.parametrize("consequent", ["by_position", "by_label"])
def test_scores_of_odd_values(spark, consequent, aligned):
    """NULL, NaN, infinite and zero values, short series and a missing key."""
    nan, inf = float("nan"), float("inf")

    def series(seed, lengths):
        draw = random.Random(seed)
        some = lambda odd, x: draw.choice(odd) if draw.random() < 0.1 else round(x, 2)
        rows = [(key, t, some([0.0, 1.0, None, nan, inf], draw.uniform(1, 3)), *[some([None, nan], draw.random()) for _ in range(2)])
                for key, n in lengths.items() for t in range(n)]
        return spark.createDataFrame(rows, "key string, i bigint, v0 double, v1 double, v2 double")

    lengths = {f"k{n}": n for n in range(1, 30)} | {None: 6}
    train, test = series(1, lengths), series(2, {k: n * 7 % 13 + 1 for k, n in lengths.items()})
    models = model_table(spark, lengths)
    got, want = ({(r["key"], r["model"]): r["rmse"] for r in scoring.score_models(
        train, test, models, WHOLE, consequent=consequent, align_test=aligned, strategy=s).collect()} for s in ("batch", "relational"))
    assert len(got) == 58 and None in got.values()
    known = {k: r for k, r in want.items() if r is not None}
    assert {k: r for k, r in got.items() if r is not None} == pytest.approx(known, rel=1e-9, nan_ok=True)


def test_two_point_test_series(spark, tables):
    train, _, _ = tables
    models = model_table(spark, ["a"])
    test = table(spark, {"a": TEST["two"]})
    assert [r["rmse"] for r in scoring.score_models(train, test, models, WHOLE).collect()] == [0.0, 0.0]
    one = table(spark, {"a": [v[:1] for v in TEST["two"]]})
    scores = scoring.score_models(train, one, models, WHOLE)
    assert [r["rmse"] for r in scores.collect()] == [None, None]
    assert scoring.mean_score(scores).first()["rmse"] is None


def test_forecast_by_variable(spark, tables):
    train, test, models = tables
    rules = ru.mine_all_rules(train, models, WHOLE)
    got = fc.forecast_by_variable(test, rules, models, layout=WHOLE)
    cuts = CUTS[1]
    price, others = plain.labelled(TRAIN["a"], cuts, True)
    now, seen = plain.labelled(TEST["a"], cuts, False)
    for k in (1, 2):
        own = [t for t in plain.all_tables(others, price) if t[0] == k - 1]
        want = plain.forecast(plain.midpoints(cuts[0]), own, seen, now)
        rows = got.where(f"key = 'a' and model = 1 and var = {k} and t >= 2").orderBy("t").collect()
        assert [r["rate"] for r in rows] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("strategy,layout", [("relational", WHOLE), ("relational", SeriesLayout(16)), ("batch", WHOLE), ("batch", SeriesLayout(16)), ("batch", SeriesLayout(5))])
@pytest.mark.parametrize("consequent", ["by_position", "by_label"])
def test_fitness(spark, tables, strategy, layout, consequent):
    train = tables[0]
    population = model_table(spark, ["a", "b", "hot", "tiny"]).selectExpr("*", "model - 1 as ind").drop("model").selectExpr("*", "1 as model")
    scored = training.evaluate_population(train, population, layout, strategy=strategy, consequent=consequent)
    got = {(r["key"], r["ind"]): r["fitness"] for r in scored.collect()}
    assert got.pop(("tiny", 0)) is None and got.pop(("tiny", 1)) is None
    want = {(key, m - 1): plain.fitness(TRAIN[key], cuts, consequent=consequent) for key in ("a", "b", "hot") for m, cuts in CUTS.items()}
    assert got == pytest.approx(want, rel=1e-12)


def test_relational_fitness_moves_steps_only(spark, tables, capsys):
    """Rules of short series are counted where the steps are: none is shuffled, stored in maps or looked up."""
    population = model_table(spark, ["a", "b", "hot"]).selectExpr("*", "0 as ind")
    training.evaluate_population(tables[0], population, WHOLE, strategy="relational").explain()
    plan = capsys.readouterr().out
    assert "map_from_entries" not in plan and "collect_list(entry" not in plan
    assert plan.count("Generate posexplode") == 1


def test_relational_fitness_sorts_once_for_all_orders(spark, tables, capsys):
    """The finest groups of a variable are sorted for; the windows of the coarser ones take that order."""
    population = model_table(spark, ["a", "b", "hot"]).selectExpr("*", "0 as ind")
    training.evaluate_population(tables[0], population, WHOLE, strategy="relational").explain()
    lines = capsys.readouterr().out.splitlines()
    sorts, windows = ([line for line in lines if f"{node} [" in line and "a1#" in line] for node in ("Sort", "Window"))
    variables = len(ru.covariate_terms(population)) // 3
    assert len(sorts) == variables and len(windows) == 3 * variables


@pytest.mark.parametrize("longest,consequent", list(zip((63, 64, None), fc.CONSEQUENTS)))
def test_counts_of_a_whole_series_fit(spark, longest, consequent):
    """One antecedent and one consequent nearly throughout, so that a count is as high as a series is long."""
    series = spark.createDataFrame(
        [(key, t, 1.01 ** (t + (t > 40)), None if key == "gap" and t % 7 == 0 else 1.0) for key in ("a", "gap") for t in range(longest or 63)],
        "key string, i bigint, v0 double, v1 double")
    models = spark.createDataFrame(
        [(key, 1, ind, [0.005, 0.015][:2 - ind], [0.5]) for key in ("a", "gap") for ind in (0, 1)],
        "key string, model int, ind int, c0 array<double>, c1 array<double>")
    layouts = [SeriesLayout(whole_keys=True, longest=longest), SeriesLayout(1 << fc.COUNT_BITS, whole_keys=True)]
    assert [bool(fc.count_bits(layout)) for layout in layouts] == [True, False]
    whole, plain_way = (
        {(r["key"], r["ind"]): r["fitness"] for r in training.evaluate_population(
            series, models, layout, strategy="relational", consequent=consequent).collect()}
        for layout in layouts
    )
    assert whole == pytest.approx(plain_way, rel=1e-12) and len(whole) == 4


def test_batch_slices(spark, tables):
    train = tables[0]
    population = model_table(spark, ["a", "hot"]).selectExpr("*", "model - 1 as ind").drop("model").selectExpr("*", "1 as model")
    want = {(r["key"], r["ind"]): r["fitness"] for r in training.evaluate_population(train, population, WHOLE, strategy="batch").collect()}
    sliced = training.evaluate_population(train, population, WHOLE, strategy="batch", slices=3)
    assert {(r["key"], r["ind"]): r["fitness"] for r in sliced.collect()} == pytest.approx(want, rel=1e-12)


def test_equal_individuals_are_scored_once(spark, tables, monkeypatch):
    """Individuals with equal cuts share a fitness, and a known one is taken as it is."""
    steps = ru.forecast_steps(tables[0].where("key = 'a'"), WHOLE).where("t >= 1").toArrow()
    one, two = (r.asDict() for r in model_table(spark, ["a"]).orderBy("model").collect())
    members = spark.createDataFrame([{**m, "known": k} for m, k in ((one, None), (two, 7.5), (one, None), (two, None))],
                                    "key string, model int, c0 array<double>, c1 array<double>, c2 array<double>, known double").toArrow()
    scored, plainly = [], batch._round
    monkeypatch.setattr(batch, "_round", lambda cell, genes, *rest: scored.append(len(genes[0][1])) or plainly(cell, genes, *rest))
    got = batch._score(steps, members, ["c0", "c1", "c2"], 10, "by_position", 100.0).to_pylist()
    want = plain.fitness(TRAIN["a"], CUTS[1])
    assert got == pytest.approx([want, 7.5, want, 7.5], rel=1e-12) and scored == [1]


def test_labels_of_unsorted_cuts():
    import numpy as np

    draw = np.random.default_rng(3)
    values = np.round(draw.standard_normal(300), 1)
    values[::17], values[5] = np.nan, np.inf
    valid = draw.random(300) < 0.9
    sizes = draw.integers(1, 9, 20)
    points = np.full((20, 8), np.nan)
    for row, n in zip(points, sizes):
        row[:n] = np.round(draw.standard_normal(n), 1)
    want = [[-1 if not ok else next((j for j in range(n) if row[j] > x), n) for x, ok in zip(values, valid)] for row, n in zip(points, sizes)]
    assert batch._labels(points, sizes, values, valid).tolist() == want


def test_batch_rounds(spark, tables, monkeypatch):
    """Individuals done one at a time score as all at once."""
    steps = ru.forecast_steps(tables[0].where("key = 'a'"), WHOLE).where("t >= 1").toArrow()
    members = model_table(spark, ["a"]).toArrow()
    score = lambda: batch._score(steps, members, ["c0", "c1", "c2"], 10, "by_position", 100.0).to_pylist()
    at_once = score()
    monkeypatch.setattr(batch, "_CELLS", 1)
    assert score() == pytest.approx(at_once, rel=1e-12)
    assert at_once == pytest.approx([plain.fitness(TRAIN["a"], cuts) for cuts in CUTS.values()], rel=1e-12)


def test_zero_price_leaves_rules_out(spark):
    prices = [1.0, 2.0, 0.0, 3.0, 4.0, 5.0, 4.0, 5.0]
    series = spark.createDataFrame([("a", t, p, 1.0) for t, p in enumerate(prices)], "key string, i bigint, v0 double, v1 double")
    models = spark.createDataFrame([("a", 1, 0, [0.0], [0.5])], "key string, model int, ind int, c0 array<double>, c1 array<double>")
    rules = ru.mine_rules(series, models, 1, 1, WHOLE)
    assert rules.agg({"n": "sum"}).first()[0] == 5  # 6 steps, one leaves a zero price
    both = [training.evaluate_population(series, models, WHOLE, strategy=s).first()["fitness"] for s in ("relational", "batch")]
    assert both[0] == pytest.approx(both[1], rel=1e-12)


@pytest.mark.parametrize("bad", [[], [float("nan")], [float(j) for j in range(10)]])
def test_bad_cuts_stop_the_job(spark, tables, bad):
    models = spark.createDataFrame([("a", 1, [0.0], bad, [0.5])], model_table(spark, ["a"]).schema)
    with pytest.raises(Exception, match="bad cut array c1"):
        ru.mine_all_rules(tables[0], models, WHOLE).collect()


def test_discretize_and_align(spark, tables):
    train, _, models = tables
    labels = ru.discretize(train, models, SeriesLayout(16))
    cuts = CUTS[2]
    price, others = plain.labelled(TRAIN["b"], cuts, True)
    aligned = ru.align_covariates(labels).where("key = 'b' and model = 2")
    for k, want in enumerate([price, *others]):
        assert [r["label"] for r in aligned.where(f"var = {k}").orderBy("i").collect()] == want


def test_report(spark):
    means = spark.createDataFrame([(f"k{j:02d}", float(j)) for j in range(1, 13)], "key string, rmse double").repartition(4)
    assert scoring.report_slice_mean(means).first()["slice_mean"] == pytest.approx(sum(range(2, 11)) / 9)
    assert scoring.report_slice_mean(means.where("rmse = 1")).first()["slice_mean"] is None
    assert [r["key"] for r in scoring.report_sorted(means).collect()] == [f"k{j:02d}" for j in range(1, 13)]
