"""Population operators and the search: properties that must hold."""

from collections import Counter
from dataclasses import replace
from itertools import product
from random import Random

import pytest
from test_forecast import TRAIN, WHOLE, model_table, table

from rulecast.operators import population as po
from rulecast.operators import series as se
from rulecast.operators.layout import SeriesLayout
from rulecast.operators.rules import Sets
from rulecast.plans import training
from rulecast.plans.scoring import score_models

SEARCH = po.Search(population=9, elite=2, tournament=3, mutation_rate=0.5, init="random", generations=3, seed=2)
CUTS = ["c0", "c1", "c2"]
POOL = "key string, model int, ind int, fitness double, c0 array<double>, lo array<double>, hi array<double>"


@pytest.fixture(scope="module")
def train(spark):
    return table(spark, TRAIN).cache()


@pytest.fixture(scope="module")
def scored(train):
    population = po.init_population(se.series_range(train, WHOLE), SEARCH, 3)
    return training.evaluate_population(train, population, WHOLE).cache()


def genes(df):
    return {(r["key"], r["model"], r["ind"]): [r[c] for c in CUTS] for r in df.collect()}


@pytest.mark.parametrize("wrong", [
    {"elite": 0}, {"elite": 9}, {"tournament": 9}, {"tournament": 0}, {"init": "x"}, {"repeats": 0}, {"generations": -1},
])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        po.Search(**{"population": 9, "elite": 2, "tournament": 3, **wrong})
    with pytest.raises(ValueError):
        Sets(2, 10)


def test_initial_cuts(train):
    ranges = se.series_range(train, WHOLE)
    uniform = genes(po.init_cuts_uniform(ranges, SEARCH, 3))
    assert all(len(c) == 8 for g in uniform.values() for c in g)
    assert len({tuple(g[0]) for (k, _, _), g in uniform.items() if k == "a"}) == 1
    drawn = genes(po.init_cuts_random(ranges, SEARCH, 3))
    assert all(len(c) == 9 and c == sorted(c) for g in drawn.values() for c in g)
    ranged = [g for (key, _, _), g in drawn.items() if key != "tiny"]  # that has a single rate
    assert len({tuple(g[0]) for g in ranged}) == len(ranged)


def test_elite_is_best_and_kept(scored):
    best = po.select_elite(scored, 2).collect()
    fitness = {}
    for r in scored.collect():
        fitness.setdefault(r["key"], []).append(r["fitness"])
    for r in best:
        assert r["fitness"] == sorted(fitness[r["key"]], key=lambda f: (f is None, f or 0))[r["rank"]]
    assert set(fitness["tiny"]) == {None}
    bred, old = genes(po.next_generation(scored, SEARCH, 0)), genes(scored)
    for r in best:
        assert bred[r["key"], r["model"], r["rank"]] == old[r["key"], r["model"], r["ind"]]


def test_ties_go_to_the_lower_index(spark):
    rows = [("a", 1, j, 1.0) for j in range(5)]
    tied = spark.createDataFrame(rows, "key string, model int, ind int, fitness double").repartition(3)
    assert sorted(r["ind"] for r in po.select_elite(tied, 2).collect()) == [0, 1]


def test_parents_differ(scored):
    pairs = po.tournament_select(scored, SEARCH).collect()
    assert len(pairs) == len(TRAIN) * 4  # 7 places to fill
    assert all(r["parent1"] != r["parent2"] for r in pairs)


def test_tournament_prefers_the_fit(spark):
    rows = [("a", m, j, float(j), [1.0], [], []) for m in range(300) for j in range(6)]
    search = po.Search(population=6, elite=4, tournament=2)
    pairs = po.tournament_select(spark.createDataFrame(rows, POOL), search).collect()
    share = [sum(r["parent1"] == j for r in pairs) / len(pairs) for j in range(6)]
    # winner of 2 out of 6 is j in (5 - j) / 15 of the cases, less the redrawn ties
    assert share[0] > share[2] > share[4] and share[5] == 0


def test_pairs_are_those_of_repeated_tournaments(spark):
    """Against a literal sampler that repeats both tournaments until the winners differ;
    two members have the same fitness, one has none, all values are tiny."""
    fitness = [3e-10, 1e-10, 4e-10, 1e-10, None, 2e-10]
    search = po.Search(population=6, elite=2, tournament=3)
    rows = [("a", m, j, f, [1.0], [], []) for m in range(4000) for j, f in enumerate(fitness)]
    got = Counter((r["parent1"], r["parent2"]) for r in po.tournament_select(spark.createDataFrame(rows, POOL), search).collect())
    draw, want = Random(1), Counter()

    def winner():
        drawn = draw.sample(range(6), 3)
        return min(drawn, key=lambda j: (fitness[j] is None, fitness[j] or 0, drawn.index(j)))

    while want.total() < got.total():
        a, b = winner(), winner()
        if a != b:
            want[a, b] += 1
    for pair in product(range(6), repeat=2):
        expected = want[pair]
        assert abs(got[pair] - expected) <= 5 * (2 * expected + 1) ** 0.5, (pair, got[pair], expected)


def test_untrainable_series_leave_the_others_alone(spark):
    good = TRAIN["b"]
    data = {
        "good": good,
        "point": [v[:1] for v in good],
        "empty": [good[0], [None] * len(good[0]), *good[2:]],
        "zero": [[0.0] * len(good[0]), *good[1:]],
        "nan": [good[0], [float("nan"), *good[1][1:]], *good[2:]],
    }
    search = po.Search(**{**SEARCH.__dict__, "generations": 1})
    for layout in (WHOLE, SeriesLayout(16)):
        models = training.fit_cuts(table(spark, data), search, layout)
        fitness = {r["key"]: r["fitness"] for r in models.collect()}
        assert set(fitness) == set(data)
        assert {k for k, f in fitness.items() if f is None} == {"point", "empty", "zero"}
        alone = training.fit_cuts(table(spark, {"good": good}), search, layout)
        assert genes_of_models(models)["good", 1] == genes_of_models(alone)["good", 1]
        scores = score_models(table(spark, data), table(spark, data), models, layout).collect()
        assert {r["key"] for r in scores if r["rmse"] is not None} == {"good", "nan"}


def test_offspring(scored):
    bred = genes(po.next_generation(scored, SEARCH, 0))
    assert sorted(bred) == sorted(genes(scored))
    assert all(1 < len(c) < 10 for g in bred.values() for c in g)
    kids = genes(po.crossover_population(scored, SEARCH))
    assert {ind for _, _, ind in kids} == set(range(2, 9))


def test_same_seed_same_offspring(scored):
    first = genes(po.next_generation(scored, SEARCH, 0))
    assert genes(po.next_generation(scored.repartition(5), SEARCH, 0)) == first
    assert genes(po.next_generation(scored, SEARCH, 1)) != first


def test_no_crossover_copies_parents(scored):
    copies = genes(po.crossover_population(scored, po.Search(**{**SEARCH.__dict__, "crossover_rate": 0.0})))
    old = {(k, str(g)) for (k, _, _), g in genes(scored).items()}
    assert all((k, str(g)) in old for (k, _, _), g in copies.items())


def test_best_fitness_never_rises(train):
    best = []
    for generations in range(4):
        search = po.Search(**{**SEARCH.__dict__, "generations": generations})
        models = training.fit_cuts(train, search, WHOLE).collect()
        assert [(r["max_price_set"], r["max_item_set"]) for r in models] == [(10, 10)] * len(TRAIN)
        best.append({r["key"]: r["fitness"] for r in models if r["fitness"] is not None})
        assert len(best[-1]) == len(TRAIN) - 1
    for before, after in zip(best, best[1:]):
        assert all(after[k] <= before[k] for k in before)


def test_blocks_find_the_same_models(train):
    search = po.Search(**{**SEARCH.__dict__, "generations": 1})
    whole = genes_of_models(training.fit_cuts(train, search, WHOLE))
    assert genes_of_models(training.fit_cuts(train, search, SeriesLayout(16))) == whole


def genes_of_models(models):
    return {(r["key"], r["model"]): [r[c] for c in CUTS] for r in models.collect()}


def test_repeats_are_independent(train):
    search = po.Search(**{**SEARCH.__dict__, "generations": 0, "repeats": 2})
    models = genes_of_models(training.train_series(train, layout=WHOLE, search=search))
    assert len(models) == 2 * len(TRAIN) and models["a", 1] != models["a", 2]


def test_trainers(spark, train):
    only_price = training.train_series(train, lambda s: s.selectExpr("key", "v0").distinct(), values=["v0"])
    assert only_price.columns == ["key", "v0"]
    price_models = training.train_series(
        train, values=["v0"], layout=WHOLE, search=po.Search(population=4, elite=1, tournament=2, generations=1)
    )
    assert "c1" not in price_models.columns and price_models.count() == len(TRAIN)

    def last(rows):
        return rows.tail(1)[["key", "i"]]

    ends = training.train_series_with(train, last, "key string, i bigint", WHOLE).collect()
    assert {r["key"]: r["i"] for r in ends} == {k: len(v[0]) - 1 for k, v in TRAIN.items()}
    with pytest.raises(ValueError):
        training.train_series_with(train, last, "key string, i bigint", SeriesLayout())


def test_streamed_trainer(spark, train):
    """A running state over batches that are shorter than a series; a function may stop early."""
    import pyarrow as pa

    def sums(key, batches):
        total, n, sorted_ = 0.0, 0, True
        for batch in batches:
            places = batch.column("i").to_pylist()
            sorted_ &= places == [*range(n, n + len(places))]
            total, n = total + sum(batch.column("v0").to_pylist()), n + len(places)
            if key == "b" and n > 5:
                break
        yield pa.RecordBatch.from_pydict({"key": [key], "total": [total], "n": [n], "sorted": [sorted_]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {r["key"]: (r["total"], r["n"], r["sorted"]) for r in training.train_series_streamed(
            train.repartition(3), sums, "key string, total double, n bigint, sorted boolean").collect()}
    finally:
        spark.conf.set(name, before)
    assert all(x[2] for x in got.values()) and 5 < got.pop("b")[1] <= 13
    assert got == {k: (pytest.approx(sum(v[0])), len(v[0]), True) for k, v in TRAIN.items() if k != "b"}


def test_streamed_trainer_sorts_packed_blocks(spark, monkeypatch):
    """The task of a series gets a row for each block, whatever their columns; rows without a key
    or place are a part of the job too."""
    import datetime

    import pyarrow as pa

    monkeypatch.setattr(training, "PACKED_ROWS", 100)
    day = datetime.datetime(2020, 1, 1)
    rows = [(k, i, day + datetime.timedelta(i), float(i), None if i % 3 else [i, None], f"é{i}" if i % 2 else None)
            for k in ("a", None, "b") for i in range(1050)] + [("a", None, None, -1.0, None, None)]
    names = ["key", "i", "ts", "v0", "x`y", "block"]
    series = spark.createDataFrame(rows, "key string, i int, ts timestamp, v0 double, `x``y` array<int>, block string").repartition(5)

    def seen(key, batches):
        got = pa.Table.from_batches(batches)
        places = got["i"].to_pylist()
        ok = places == sorted(places, key=lambda i: -1 if i is None else i) and got.column_names == names
        times = [None if i is None else day + datetime.timedelta(i) for i in places]
        ok &= [None if t is None else t.replace(tzinfo=None) for t in got["ts"].to_pylist()] == times
        ok &= got["block"].to_pylist() == [f"é{i}" if i and i % 2 else None for i in places]
        ok &= got["x`y"].to_pylist() == [[i, None] if i is not None and i % 3 == 0 else None for i in places]
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "n": [len(places)], "ok": [ok]})

    trained = training.train_series_streamed(series, seen, "key string, n bigint, ok boolean")
    assert sorted(map(tuple, trained.collect()), key=str) == [("a", 1051, True), ("b", 1050, True), (None, 1050, True)]
    plan = trained._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Sort ") == 2


def exchanges(df):
    """Shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" +-:*").startswith("Exchange ") for line in plan.splitlines())


def test_a_generation_shuffles_once(spark, train, tmp_path):
    """Neither the steps nor the population move; the scored individuals do, once."""
    from rulecast.operators.forecast import first_moves
    from rulecast.operators.rules import forecast_steps
    from rulecast.settle import discard, settle_by

    steps = settle_by(forecast_steps(train, WHOLE), ["key"], str(tmp_path / "steps"), ("t",))
    population = settle_by(po.init_population(se.series_range(train, WHOLE), SEARCH, 3), ["key"], str(tmp_path / "people"))
    scored = training.evaluate_steps(steps, first_moves(train), population, WHOLE, SEARCH.sets)
    assert exchanges(scored) == 0
    bred = po.next_generation(scored, SEARCH, 0)
    assert exchanges(bred) == 1 and exchanges(bred.repartition(8, "key")) == 1
    assert genes(bred) == genes(po.next_generation(training.evaluate_population(train, population, WHOLE), SEARCH, 0))
    discard(spark, str(tmp_path / "people"))
    assert not (tmp_path / "people").exists() and (tmp_path / "steps").exists()


def test_selection_of_a_large_pool(spark):
    """Bisection finds the same parents as a search from the front, in a population of any size."""
    import time

    seconds = []
    for n in (300, 12_000):
        search = po.Search(population=n, elite=2, tournament=5)
        rows = spark.range(n).selectExpr("'a' as key", "1 as model", "int(id) as ind", "double(pmod(hash(id), 1000)) as fitness",
                                         "array(1D) as c0", "array(0D) as lo", "array(1D) as hi").cache()
        start = time.time()
        pairs = po.tournament_select(rows, search).collect()
        seconds.append(time.time() - start)
        assert len(pairs) == (n - 1) // 2 and all(p["parent1"] != p["parent2"] for p in pairs)
        fitness = {r["ind"]: r["fitness"] for r in rows.collect()}
        mean = sum(fitness[p[c]] for p in pairs for c in ("parent1", "parent2")) / len(pairs) / 2
        assert abs(mean - 1000 / 6) < 30  # the best of five of 0 to 999
    assert seconds[1] < 40 * seconds[0]


def test_repair_and_trim_spare_the_elite(spark):
    close = [1.0, 1.01, 2.0, 3.0]
    rows = [("a", 1, ind, close, [float(j) for j in range(12)], [0.0] * 2, [1.0] * 2) for ind in range(3)]
    population = spark.createDataFrame(rows, "key string, model int, ind int, c0 array<double>, c1 array<double>, lo array<double>, hi array<double>")
    repaired = {r["ind"]: r["c0"] for r in po.repair_cuts(population, elite=1).collect()}
    assert repaired[0] == close and repaired[1] == [1.01, 3.0]
    search = po.Search(population=3, elite=1, tournament=2)
    trimmed = {r["ind"]: r["c1"] for r in po.trim_cuts(population, search).collect()}
    assert len(trimmed[0]) == 12 and len(trimmed[1]) == 9


def test_series_of_one_block_are_scored_at_once(spark, train, monkeypatch):
    """Only longer series send their counts through Spark."""
    from rulecast.plans import batch_fitness

    population = po.init_population(se.series_range(train, WHOLE), SEARCH, 3)

    def scores(layout):
        rows = training.evaluate_population(train, population, layout, SEARCH.sets).collect()
        return {(r["key"], r["model"], r["ind"]): r["fitness"] for r in rows}

    whole, mixed = scores(WHOLE), scores(SeriesLayout(block_rows=12))
    monkeypatch.setattr(batch_fitness, "_in_blocks", None)
    at_once = scores(SeriesLayout(block_rows=1_000))
    assert whole.keys() == mixed.keys() == at_once.keys() and any(whole.values())
    for who, fitness in whole.items():
        for other in (mixed, at_once):
            assert other[who] == (fitness and pytest.approx(fitness))


def test_many_series_are_scored_at_a_time(spark):
    """Each as if it were alone; a series without a name is one of its own."""
    rows = [(k, i, float(100 + (i * 7 + j) % 13), float((i * 5 + j) % 4)) for j, k in enumerate(["a", "b", "c", None]) for i in range(20 + j)]
    series = spark.createDataFrame(rows, "key string, i bigint, v0 double, v1 double")
    people = [(k, 1, ind, [-0.05, 0.0, 0.02 * ind + 0.01], [0.5, 1.5 + ind]) for k in ("a", "b", "c", None, "none") for ind in range(3)]
    population = spark.createDataFrame(people, "key string, model int, ind int, c0 array<double>, c1 array<double>")
    alone = []
    for name in ("a", "b", "c"):
        alone += training.evaluate_population(
            series.where(f"key = '{name}'"), population.where(f"key = '{name}'"), WHOLE).collect()
    got = {(r["key"], r["ind"]): r["fitness"] for r in training.evaluate_population(series, population, WHOLE).collect()}
    assert len(got) == 15 and all(got[r["key"], r["ind"]] == pytest.approx(r["fitness"]) for r in alone)
    assert all(got[None, ind] > 0 for ind in range(3)) and all(got["none", ind] is None for ind in range(3))
    relational = training.evaluate_population(series, population, WHOLE, strategy="relational").collect()
    assert all(got[r["key"], r["ind"]] == pytest.approx(r["fitness"]) for r in relational if r["fitness"] is not None)
    assert sum(r["fitness"] is not None for r in relational) == 9


def test_a_batch_is_scored_in_shares():
    import numpy as np

    from rulecast.plans.batch_fitness import _CELLS, _shares

    cells = np.array([_CELLS * 2, 1, _CELLS - 1, 1, 5])
    assert [part.tolist() for part in _shares(cells)] == [[0], [1, 2], [3, 4]]


def test_series_of_sorted_frames():
    """Series may go on over frames; a missing key is one of its own."""
    import pandas as pd

    keys = [None, None, "a", "a", "a", "b", "c", "c"]
    rows = pd.DataFrame({"key": keys, "i": range(8)})
    for size in (1, 2, 3, 8):
        frames = [rows.iloc[at:at + size] for at in range(0, 8, size)]
        got = [part["i"].tolist() for part in training._one_series_each(iter([rows.head(0), *frames]))]
        assert got == [[0, 1], [2, 3, 4], [5], [6, 7]]


def test_a_search_lists_the_steps_once(spark, train, monkeypatch):
    """Generations take the steps of whole series as lists; a list scores as its rows, without a name too."""
    from rulecast.operators.rules import forecast_steps
    from rulecast.plans.batch_fitness import gathered_steps

    rows = [(k, i, float(100 + (i * 7 + j) % 13), float((i * 5 + j) % 4)) for j, k in enumerate(["a", "b", None]) for i in range(20 + j)]
    steps = forecast_steps(spark.createDataFrame(rows, "key string, i bigint, v0 double, v1 double"), WHOLE)
    people = [(k, 1, ind, [-0.05, 0.0, 0.02 * ind + 0.01], [0.5, 1.5 + ind]) for k in ("a", "b", None, "none") for ind in range(3)]
    population = spark.createDataFrame(people, "key string, model int, ind int, c0 array<double>, c1 array<double>")
    listed = gathered_steps(steps, ["c0", "c1"], ["key"])
    assert listed.count() == 3
    for slices in (1, 2):
        got, want = ({(r["key"], r["ind"]): r["fitness"] for r in training.evaluate_steps(
            table, None, population, WHOLE, SEARCH.sets, slices=slices).collect()} for table in (listed, steps))
        assert len(got) == 12 and got == pytest.approx(want) and got[None, 0] > 0

    seen, plainly = [], training.evaluate_steps
    monkeypatch.setattr(training, "evaluate_steps", lambda steps, *rest: seen.append(steps.columns) or plainly(steps, *rest))
    training.fit_cuts(train, SEARCH, WHOLE)
    assert seen == [["key", "steps"]] * (SEARCH.generations + 1)

def test_series_of_one_block_are_searched_as_whole_ones(spark, train, monkeypatch):
    """A series table without a second block needs no blocks."""
    seen, plainly = [], training.evaluate_steps
    monkeypatch.setattr(training, "evaluate_steps", lambda steps, *rest: seen.append(rest[2].whole_keys) or plainly(steps, *rest))
    search = replace(SEARCH, generations=1)
    models = [{r["key"]: (r["c0"], r["fitness"]) for r in training.fit_cuts(train, search, SeriesLayout(block_rows=n)).collect()}
              for n in (1_000, 12)]
    assert seen == [True, True, False, False]
    assert models[0].keys() == models[1].keys()
    for key, (cuts, fitness) in models[0].items():
        assert models[1][key][0] == cuts and models[1][key][1] == (fitness and pytest.approx(fitness))


def test_the_first_population_is_made_by_all_tasks(spark, train, monkeypatch):
    """However few partitions the ranges of the series lie in."""
    seen, make = [], training.init_population
    monkeypatch.setattr(training, "init_population", lambda ranges, *rest: seen.append(ranges.rdd.getNumPartitions()) or make(ranges, *rest))
    training.fit_cuts(train, replace(SEARCH, generations=0), WHOLE)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


@pytest.mark.parametrize("consequent", ["by_position", "by_label", "unguarded"])
def test_fitness_of_many_labels(spark, consequent):
    """More labels than a word of places holds, missing and undefined values; counts by sorted codes as by Spark."""
    import numpy as np

    from rulecast.plans.batch_fitness import _sorted

    draw, sets = Random(5), Sets(14, 23)
    odd = [None, float("nan"), 0.0]
    rows = [(k, i, draw.choice(odd) if draw.random() < 0.05 else draw.uniform(1, 2), draw.choice(odd) if draw.random() < 0.1 else float(draw.randrange(25)))
            for k in "ab" for i in range(90)]
    series = spark.createDataFrame(rows, "key string, i bigint, v0 double, v1 double")
    people = [(k, 1, ind, [draw.uniform(-0.5, 0.5) for _ in range(13 - ind)], [draw.uniform(0, 25) for _ in range(22 - ind)]) for k in "ab" for ind in range(4)]
    population = spark.createDataFrame(people, "key string, model int, ind int, c0 array<double>, c1 array<double>")
    got, want = ({(r["key"], r["ind"]): r["fitness"] for r in training.evaluate_population(
        series.where("v0 is null or not isnan(v0)"), population, WHOLE, sets, strategy, consequent=consequent).collect()}
        for strategy in ("batch", "relational"))
    assert len(got) == 8 and got == pytest.approx(want)

    for high in (9, 2**60):  # the second does not fit one number with the entry
        code = np.array([3, high, 1, 3, high, 0])
        ordered, entry = _sorted(code, np.arange(6), 6)
        assert ordered.tolist() == sorted(code.tolist()) and code[entry].tolist() == ordered.tolist()


def test_the_default_trainer_lists_the_steps_once(train, monkeypatch):
    """As a search on its own, for the price with covariates; the price alone has nothing to list."""
    seen, plainly = [], training.evaluate_steps
    monkeypatch.setattr(training, "evaluate_steps", lambda steps, *rest: seen.append(steps.columns) or plainly(steps, *rest))
    search = replace(SEARCH, generations=0)
    training.train_series(train, layout=WHOLE, search=search)
    training.train_series(train, values=["v0"], layout=WHOLE, search=search)
    assert seen[0] == ["key", "steps"] and "steps" not in seen[1] and len(seen) == 2
