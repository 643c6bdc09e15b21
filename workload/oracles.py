"""DuckDB SQL for the registered queries.

The statements are put together from named parts (common table expressions).
They compute the same results in another way where there is one: rules are
counted by joining label positions, forecasts by joining every antecedent with
every midpoint, repair by recursion.
"""

from __future__ import annotations

from math import comb

from workload.queries import CROSSING, RANDOM, SMALL, UNIFORM

V = range(5)
VALUES = ", ".join(f"v{k}" for k in V)
WHO = "key, model, ind"


def draw(seed, purpose, *names) -> str:
    parts = ", ".join(str(n) for n in names)
    return (
        f"(('0x' || substr(md5(concat_ws('|', '{seed}|{purpose}', {parts})), 1, 8))::BIGINT"
        " / 4294967296.0::DOUBLE)"
    )


def label(cuts, x) -> str:
    return (
        f"coalesce(nullif(list_position(list_transform({cuts}, lambda c: c > {x}), true), 0) - 1,"
        f" len({cuts}))::INTEGER"
    )


SHORT_KEY = "l_suppkey || '/' || year(l_shipdate) AS key"
OBS = (
    f"obs AS (SELECT {SHORT_KEY}, l_shipdate AS ts,"
    " l_extendedprice AS v0, l_quantity AS v1, l_discount AS v2, l_tax AS v3,"
    " l_linenumber::DOUBLE AS v4 FROM lineitem)"
)


def indexed(name, where="true") -> str:
    return (
        f"{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts, {VALUES}) - 1 AS i,"
        f" ts, {VALUES} FROM obs WHERE {where})"
    )


WHOLE = [OBS, indexed("series")]
TRAIN = [OBS, indexed("train", "month(ts) <= 10")]
FIT = [OBS, indexed("train")]  # whole series, where no hold-out is scored
TEST = [indexed("test", "month(ts) > 10")]


def rates(series) -> str:
    return (
        f"{series}_rate AS (SELECT * FROM (SELECT key, i,"
        f" (lead(v0) OVER (PARTITION BY key ORDER BY i) - v0) / v0 AS rate FROM {series}) WHERE rate IS NOT NULL)"
    )


def ranges(series) -> list[str]:
    parts = [f"SELECT key, 0 AS var, min(rate) AS lo, max(rate) AS hi FROM {series}_rate GROUP BY key"]
    parts += [
        f"SELECT key, {k} AS var, min(v{k}) AS lo, max(v{k}) AS hi FROM {series} GROUP BY key"
        for k in V if k
    ]
    return [rates(series), f"ranges AS ({' UNION ALL '.join(parts)})"]


def population(search) -> list[str]:
    """``pop0``: (key, model, ind, var, cuts, lo, hi)."""
    top = search.sets.price
    if search.init == "uniform":
        cuts = f"list_transform(range(1, {top - 1}), lambda j: lo + (hi - lo) / {top - 1}.0::DOUBLE * j)"
    else:
        at = draw(search.seed, "init", "key", "model", "ind", "var", "j")
        cuts = f"list_sort(list_transform(range(1, {top}), lambda j: {at} * (hi - lo) + lo))"
    return [
        f"people AS (SELECT key, var, lo, hi, m.model, p.ind FROM ranges,"
        f" range(1, {search.repeats + 1}) AS m(model), range(0, {search.population}) AS p(ind))",
        f"pop0 AS (SELECT {WHO}, var, {cuts} AS cuts, lo, hi FROM people)",
    ]


def models(search, series=TRAIN) -> list[str]:
    return [*series, *ranges("train"), *population(search), "models AS (SELECT * FROM pop0 WHERE ind = 0)"]


def labels(name, series, pop, aligned) -> list[str]:
    """``{name}_p`` and ``{name}_a``: price labels, covariate labels of ``series``."""
    shift = "i - 1" if aligned else "i"
    parts = " UNION ALL ".join(f"SELECT key, {shift} AS i, {k} AS var, v{k} AS x FROM {series}" for k in V if k)
    return [
        f"{name}_p AS (SELECT {WHO}, i, {label('cuts', 'rate')} AS p"
        f" FROM {series}_rate JOIN {pop} USING (key) WHERE var = 0)",
        f"{name}_a AS (SELECT {WHO}, var, i, {label('cuts', 'x')} AS a"
        f" FROM ({parts}) JOIN {pop} USING (key, var) WHERE i >= 0"
        f" UNION ALL SELECT {WHO}, 0, i, p FROM {name}_p)",
    ]


def rules(name, lab) -> list[str]:
    over = f"OVER (PARTITION BY {WHO}, var ORDER BY i)"
    grams = " UNION ALL ".join(
        f"SELECT {WHO}, var, {o} AS ord, {text} AS antecedent, i + {o} AS at FROM {name}_g"
        for o, text in ((1, "a::VARCHAR"), (2, "a || '-' || b"), (3, "a || '-' || b || '-' || c"))
    )
    return [
        f"{name}_g AS (SELECT {WHO}, var, i, a, lead(a, 1) {over} AS b, lead(a, 2) {over} AS c FROM {lab}_a)",
        f"{name} AS (SELECT {WHO}, var, ord, antecedent, p AS consequent, count(*) AS n"
        f" FROM ({grams}) g JOIN {lab}_p AS q USING ({WHO}) WHERE q.i = g.at GROUP BY ALL)",
    ]


MULTIORDER = "var > 0"
MULTIVAR = "ord = 1"
UNI = "var = 0 AND ord = 1"


def forecast(name, series, pop, rule, lab, terms, how="by_position", extra="") -> list[str]:
    """``name``: (key, model, ind, [extra], i, rate) for every step of ``series``."""
    over = f"OVER (PARTITION BY {WHO}, var ORDER BY i)"
    seen = " UNION ALL ".join(
        f"SELECT {WHO}, var, {o} AS ord, {text} AS antecedent, i FROM {name}_h WHERE i >= {o - 1}"
        for o, text in ((1, "a::VARCHAR"), (2, "b || '-' || a"), (3, "c || '-' || b || '-' || a"))
    )
    if how == "by_label":
        weight, guard = "g.n", "g.n IS NOT NULL"
    else:
        weight, guard = "r.n", "r.n IS NOT NULL" + (" AND g.n IS NOT NULL" if how == "by_position" else "")
    key = f"{WHO}, var, ord, antecedent"
    tag = f", {extra}" if extra else ""
    return [
        f"{name}_m AS (SELECT {WHO}, j, CASE WHEN j = 0 THEN cuts[1] - 0.002::DOUBLE"
        " WHEN j = len(cuts) THEN cuts[j] + 0.002::DOUBLE ELSE (cuts[j + 1] + cuts[j]) / 2 END AS mid"
        f" FROM (SELECT {WHO}, cuts, unnest(range(0, len(cuts) + 1)) AS j FROM {pop} WHERE var = 0))",
        f"{name}_w AS (SELECT {', '.join('d.' + c.strip() for c in key.split(','))},"
        f" sum(CASE WHEN {guard} THEN {weight} * m.mid ELSE 0 END) AS u,"
        f" sum(CASE WHEN {guard} THEN {weight} ELSE 0 END)::DOUBLE AS d"
        f" FROM (SELECT DISTINCT {key} FROM {rule} WHERE {terms}) AS d JOIN {name}_m AS m USING ({WHO})"
        f" LEFT JOIN {rule} AS g ON {_same('g', 'd', key)} AND g.consequent = m.j"
        f" LEFT JOIN {lab}_p AS f ON {_same('f', 'd', WHO)} AND f.i = m.j"
        f" LEFT JOIN {rule} AS r ON {_same('r', 'd', key)} AND r.consequent = f.p GROUP BY ALL)",
        f"{name}_h AS (SELECT {WHO}, var, i, a, lag(a, 1) {over} AS b, lag(a, 2) {over} AS c FROM {lab}_a)",
        f"{name}_s AS (SELECT {WHO}{tag}, i, sum(u) AS u, sum(d) AS d FROM ({seen})"
        f" JOIN {name}_w USING ({key}) GROUP BY ALL)",
        f"{name}_n AS (SELECT key, max(i) AS last FROM {series} GROUP BY key)",
        f"{name} AS (SELECT q.key, q.model, q.ind{', e.' + extra if extra else ''}, q.i,"
        f" CASE WHEN s.d > 0 THEN s.u / s.d ELSE 0 END AS rate"
        f" FROM {lab}_p AS q JOIN {name}_n USING (key)"
        + (f" CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS {extra}) AS e" if extra else "")
        + f" LEFT JOIN {name}_s AS s ON {_same('s', 'q', WHO + ', i')}"
        + (f" AND s.{extra} = e.{extra}" if extra else "")
        + " WHERE q.i <= last - 2)",
    ]


def _same(a, b, columns) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in columns.split(","))


def prices(name, fc, series, divisor="100") -> str:
    return (
        f"{name} AS (SELECT f.{WHO.replace(', ', ', f.')}, f.i + 2 AS t, x.v0 AS actual,"
        f" b.v0 * (1 + f.rate / {divisor}.0::DOUBLE) AS price_hat FROM {fc} AS f"
        f" JOIN {series} AS b ON b.key = f.key AND b.i = f.i + 1"
        f" JOIN {series} AS x ON x.key = f.key AND x.i = f.i + 2)"
    )


def with_head(name, priced, series, pop) -> str:
    return (
        f"{name} AS (SELECT {WHO}, t, actual, price_hat FROM {priced} UNION ALL"
        f" SELECT {WHO}, i, v0, v0 FROM {series} JOIN (SELECT DISTINCT {WHO} FROM {pop}) USING (key) WHERE i < 2)"
    )


def rmse(name, priced, least=1) -> str:
    return (
        f"{name} AS (SELECT {WHO}, CASE WHEN count(*) >= {least} THEN sqrt(avg((price_hat - actual) * (price_hat - actual))) END AS rmse"
        f" FROM {priced} GROUP BY {WHO})"
    )


def evaluated(n, pop) -> list[str]:
    """``fit{n}``: (key, model, ind, fitness) of population ``pop``."""
    return [
        *labels(f"lab{n}", "train", pop, True),
        *rules(f"rules{n}", f"lab{n}"),
        *forecast(f"fc{n}", "train", pop, f"rules{n}", f"lab{n}", MULTIORDER),
        prices(f"price{n}", f"fc{n}", "train"),
        rmse(f"rmse{n}", f"price{n}"),
        f"fit{n} AS (SELECT {WHO}, rmse AS fitness FROM rmse{n})",
        f"rank{n} AS (SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY CAST(printf('%.8e', fitness) AS DOUBLE), ind) - 1"
        f" AS rank FROM fit{n})",
    ]


def couples(n, search, gen) -> list[str]:
    """``cpl{n}``: (key, model, pair, parent1, parent2) from ``fit{n}``."""
    pairs = (search.population - search.elite + 1) // 2
    size, drawn = search.population, search.tournament
    # chance that the winner has rank r or worse
    worse = ", ".join(f"'{comb(size - r, drawn) / comb(size, drawn)!r}'::DOUBLE" for r in range(size + 1))
    u = {s: draw(search.seed, s, "key", "model", gen, "pair") for s in "ab"}
    upto = "OVER (PARTITION BY key, model ORDER BY ind ROWS UNBOUNDED PRECEDING)"
    every = "OVER (PARTITION BY key, model)"
    return [
        f"pw{n} AS (SELECT key, model, ind, (worse[better + 1] - worse[better + same + 1]) / same AS p FROM"
        f" (SELECT *, [{worse}] AS worse, rank() OVER (PARTITION BY key, model ORDER BY fit) - 1 AS better,"
        " count(*) OVER (PARTITION BY key, model, fit) AS same FROM"
        f" (SELECT key, model, ind, CAST(printf('%.8e', fitness) AS DOUBLE) AS fit FROM fit{n})))",
        f"ps{n} AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY key, model ORDER BY ind) AS below FROM"
        f" (SELECT *, sum(p) {upto} AS upto, sum(p * (1 - p)) {upto} AS upto_one,"
        f" sum(p) {every} AS total, sum(p * (1 - p)) {every} AS total_one FROM pw{n}))",
        f"pd{n} AS (SELECT *, {u['a']} AS ua, {u['b']} AS ub FROM (SELECT DISTINCT key, model, pair"
        f" FROM fit{n}, range(0, {pairs}) AS p(pair)))",
        f"pa{n} AS (SELECT key, model, pair, ub, count(*) FILTER (WHERE upto_one <= ua * total_one) AS first"
        f" FROM pd{n} JOIN ps{n} USING (key, model) GROUP BY ALL)",
        f"pb{n} AS (SELECT key, model, pair, first, CASE WHEN x >= below THEN x + p ELSE x END AS x FROM"
        f" (SELECT d.*, s.p, s.below, d.ub * (s.total - s.p) AS x FROM pa{n} AS d JOIN ps{n} AS s"
        " ON s.key = d.key AND s.model = d.model AND s.ind = d.first))",
        f"cpl{n} AS (SELECT key, model, pair, first::INTEGER AS parent1,"
        f" (count(*) FILTER (WHERE upto <= x))::INTEGER AS parent2"
        f" FROM pb{n} JOIN ps{n} USING (key, model) GROUP BY key, model, pair, first)",
    ]


def children(n, pop, pairs, search, gen) -> list[str]:
    """``kids{n}``: offspring of the couples ``pairs`` in population ``pop``."""
    place = ("key", "model", gen, "pair")
    split = {
        s: f"(1 + floor({draw(search.seed, f'split-{s}', *place, 'var')} * greatest(len({s}) - 1, 1)))::BIGINT"
        for s in "ab"
    }
    crossed = f"{draw(search.seed, 'cross', *place)} < {search.crossover_rate}::DOUBLE"
    return [
        f"mates{n} AS (SELECT *, {crossed} AS crossed, {split['a']} AS sa, {split['b']} AS sb FROM"
        " (SELECT c.key, c.model, c.pair, x.var, x.lo, x.hi, x.cuts AS a, y.cuts AS b"
        f" FROM {pairs} AS c JOIN {pop} AS x ON x.key = c.key AND x.model = c.model AND x.ind = c.parent1"
        f" JOIN {pop} AS y ON y.key = c.key AND y.model = c.model AND y.ind = c.parent2 AND y.var = x.var))",
        f"kids{n} AS (SELECT key, model, ind, var, cuts, lo, hi FROM ("
        f"SELECT key, model, {search.elite} + 2 * pair AS ind, var, lo, hi,"
        f" CASE WHEN crossed THEN list_concat(a[1:sa], list_sort(b[sb + 1:])) ELSE a END AS cuts FROM mates{n}"
        f" UNION ALL SELECT key, model, {search.elite + 1} + 2 * pair, var, lo, hi,"
        f" CASE WHEN crossed THEN list_concat(b[1:sb], list_sort(a[sa + 1:])) ELSE b END FROM mates{n})"
        f" WHERE ind < {search.population})",
    ]


def mutated(name, pop, search, gen) -> str:
    def u(purpose):
        return draw(search.seed, purpose, "key", "model", gen, "ind", "var")

    top = search.sets.price
    shift = f"({u('size')} * 0.4::DOUBLE + 0.1::DOUBLE)"
    factor = f"CASE WHEN {u('sign')} < 0.5 THEN 1 - {shift} ELSE 1 + {shift} END"
    return (
        f"{name} AS (SELECT {WHO}, var, lo, hi, CASE WHEN NOT hit THEN cuts ELSE list_sort(CASE kind"
        f" WHEN 0 THEN CASE WHEN len(cuts) < {top} THEN list_append(cuts, {u('point')} * (hi - lo) + lo) ELSE cuts END"
        f" WHEN 1 THEN list_append(list_concat(cuts[1:p], cuts[p + 2:]), cuts[p + 1] * factor)"
        f" ELSE CASE WHEN len(cuts) > 2 THEN list_concat(cuts[1:p], cuts[p + 2:]) ELSE cuts END END) END AS cuts"
        f" FROM (SELECT *, ind >= {search.elite} AND {u('mutate')} < {search.mutation_rate}::DOUBLE AS hit,"
        f" floor({u('kind')} * 3)::INTEGER AS kind, floor({u('place')} * len(cuts))::BIGINT AS p, {factor} AS factor"
        f" FROM {pop}))"
    )


CLOSE = (
    "(abs(cuts[i + 2] - cuts[i + 1]) < 0.0005::DOUBLE OR coalesce(CASE WHEN cuts[i + 1] <> 0 THEN"
    " abs((cuts[i + 2] - cuts[i + 1]) / cuts[i + 1]) < 0.1::DOUBLE END, false))"
)


def repaired(name, pop, elite) -> list[str]:
    return [
        f"{name}_r AS (SELECT {WHO}, var, cuts, lo, hi, 0::BIGINT AS i, len(cuts)::BIGINT AS stop, []::DOUBLE[] AS kept FROM {pop}"
        f" UNION ALL SELECT {WHO}, var, cuts, lo, hi, i + 1, CASE WHEN {CLOSE} THEN stop - 1 ELSE stop END,"
        f" CASE WHEN {CLOSE} THEN kept ELSE list_append(kept, cuts[i + 1]) END FROM {name}_r WHERE i < stop - 1)",
        f"{name} AS (SELECT {WHO}, var, lo, hi,"
        f" CASE WHEN ind < {elite} OR len(kept) = 0 THEN cuts ELSE list_append(kept, cuts[-1]) END AS cuts"
        f" FROM {name}_r WHERE i >= stop - 1)",
    ]


def repaired_first(name, pop) -> list[str]:
    spots = f"SELECT {WHO}, var, min(i) AS spot FROM (SELECT *, unnest(range(0, len(cuts) - 1)) AS i FROM {pop}) WHERE {CLOSE} GROUP BY ALL"
    return [
        f"{name} AS (SELECT {WHO}, var, lo, hi, CASE WHEN spot IS NULL THEN cuts"
        f" ELSE list_concat(cuts[1:spot], cuts[spot + 2:]) END AS cuts FROM {pop} LEFT JOIN ({spots}) USING ({WHO}, var))"
    ]


def trimmed(name, pop, search, gen) -> list[str]:
    u = draw(search.seed, "trim", "key", "model", gen, "ind", "var", "pos")
    most = search.sets.price - 1
    return [
        f"{name} AS (SELECT {WHO}, var, any_value(lo) AS lo, any_value(hi) AS hi, list(cut ORDER BY pos) AS cuts"
        f" FROM (SELECT *, row_number() OVER (PARTITION BY {WHO}, var ORDER BY {u}, pos) AS place"
        f" FROM (SELECT {WHO}, var, lo, hi, len(cuts) AS size, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS pos FROM {pop}))"
        f" WHERE ind < {search.elite} OR place > size - {most} GROUP BY {WHO}, var)"
    ]


def bred(n, pop, search) -> list[str]:
    """``pop{n+1}`` from ``pop`` and its ``fit{n}``."""
    return [
        *couples(n, search, n),
        *children(n, pop, f"cpl{n}", search, n),
        f"all{n} AS (SELECT {WHO}, var, cuts, lo, hi FROM kids{n} UNION ALL"
        f" SELECT p.key, p.model, r.rank AS ind, p.var, p.cuts, p.lo, p.hi FROM {pop} AS p"
        f" JOIN rank{n} AS r USING ({WHO}) WHERE r.rank < {search.elite})",
        mutated(f"mut{n}", f"all{n}", search, n),
        *repaired(f"rep{n}", f"mut{n}", search.elite),
        *trimmed(f"pop{n + 1}", f"rep{n}", search, n),
    ]


def query(parts: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def listed(pop, ids=WHO) -> str:
    types = ", ".join(f"{c.strip()}::{'VARCHAR' if c.strip() == 'key' else 'INTEGER'} AS {c.strip()}" for c in ids.split(","))
    return (
        f"SELECT {types}, var::INTEGER AS var, pos::INTEGER AS pos, round(cut, 9) AS cut FROM"
        f" (SELECT {ids}, var, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS pos FROM {pop})"
    )


ID = "key, model::INTEGER AS model"


def _model_forecast(terms, how="by_position", search=UNIFORM, aligned=False, extra="") -> list[str]:
    return [
        *models(search), *TEST, rates("test"),
        *labels("tr", "train", "models", True), *rules("rules", "tr"),
        *labels("te", "test", "models", aligned),
        *forecast("fc", "test", "models", "rules", "te", terms, how, extra),
    ]


def _rates_of(terms, how="by_position", extra="") -> str:
    tag = f", {extra}::INTEGER AS {extra}" if extra else ""
    return query(
        _model_forecast(terms, how, extra=extra, aligned=terms == UNI),
        f"SELECT {ID}{tag}, i + 2 AS t, round(rate, 7) AS rate FROM fc",
    )


def _price(head: bool, divisor="100") -> str:
    parts = [*_model_forecast(MULTIORDER), prices("priced", "fc", "test", divisor)]
    if head:
        parts.append(with_head("shown", "priced", "test", "models"))
    return query(parts, f"SELECT {ID}, t, actual, round(price_hat, 4) AS price_hat FROM {'shown' if head else 'priced'}")


def _rules(where="true") -> str:
    return query(
        [*models(UNIFORM, FIT), *labels("tr", "train", "models", True), *rules("rules", "tr")],
        f"SELECT {ID}, var::INTEGER AS var, ord::INTEGER AS ord, antecedent, consequent, n FROM rules WHERE {where}",
    )


def _scores(select, how="by_position", aligned=False, divisor="100") -> str:
    return query(
        [
            *_model_forecast(MULTIORDER, how, RANDOM, aligned), prices("priced", "fc", "test", divisor),
            with_head("shown", "priced", "test", "models"), rmse("scores", "shown", 2),
            "means AS (SELECT key, avg(rmse) AS rmse FROM scores GROUP BY key)",
        ],
        select,
    )


SCORED = [*FIT, *ranges("train"), *population(SMALL), *evaluated(0, "pop0")]
CROSSED = [*SCORED, *couples(0, SMALL, 0), *children(0, "pop0", "cpl0", SMALL, 0)]
LABELS = [*models(UNIFORM, FIT), *labels("un", "train", "models", False)]
BY_FITNESS = "SELECT key, model::INTEGER AS model, ind::INTEGER AS ind, round(fitness, 4) AS fitness FROM fit0"
MEANS = "SELECT key, round(rmse, 4) AS rmse FROM means"
STATS = ", ".join(
    f"round(avg(v{k}), 6) AS mean_v{k}, round(stddev_pop(v{k}), 6) AS std_v{k},"
    f" round(min(v{k}), 6) AS min_v{k}, round(max(v{k}), 6) AS max_v{k}" for k in V
)
LONG = " UNION ALL ".join(f"SELECT key, {k}::INTEGER AS var, i, v{k} AS value FROM series" for k in V)

def naive(n, pop) -> list[str]:
    """``fit{n}`` without covariates: the price stays as it is."""
    return [
        f"naive{n} AS (SELECT key, sqrt(avg((v0 - base) * (v0 - base))) AS fitness FROM (SELECT key, i, v0,"
        " lag(v0) OVER (PARTITION BY key ORDER BY i) AS base FROM train) WHERE i >= 2 GROUP BY key)",
        f"fit{n} AS (SELECT {WHO}, fitness FROM (SELECT DISTINCT {WHO} FROM {pop}) LEFT JOIN naive{n} USING (key))",
        f"rank{n} AS (SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY ind) - 1 AS rank FROM fit{n})",
    ]


def fitted(last, parts) -> str:
    best = f"best AS (SELECT {WHO}, var, cuts, round(fitness, 4) AS fitness FROM pop{last} JOIN rank{last} USING ({WHO}) WHERE rank = 0)"
    return query(
        [*parts, best],
        f"SELECT {ID}, var::INTEGER AS var, pos::INTEGER AS pos, round(cut, 9) AS cut, fitness, 10::INTEGER AS max_price_set,"
        " 10::INTEGER AS max_item_set FROM (SELECT *, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS pos FROM best)",
    )


PRICE_RANGES = [rates("train"), "ranges AS (SELECT key, 0 AS var, min(rate) AS lo, max(rate) AS hi FROM train_rate GROUP BY key)"]
FITTED_PRICE = fitted(2, [
    *FIT, *PRICE_RANGES, *population(SMALL), *naive(0, "pop0"), *bred(0, "pop0", SMALL), *naive(1, "pop1"), *bred(1, "pop1", SMALL), *naive(2, "pop2")])


def falling(series) -> list[str]:
    """``runs``: (key, run), the longest run of falling prices, by numbering islands."""
    return [
        f"steps AS (SELECT key, i, coalesce(v0 < lag(v0) OVER (PARTITION BY key ORDER BY i), false) AS hit FROM {series})",
        "islands AS (SELECT key, count(*) AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY i) AS island"
        " FROM steps WHERE hit) GROUP BY key, island)",
        "runs AS (SELECT key, coalesce(max(run), 0) AS run FROM (SELECT DISTINCT key FROM steps) LEFT JOIN islands USING (key) GROUP BY key)",
    ]


def long_series(sql: str, key: str = "(l_suppkey % 50)::VARCHAR AS key") -> str:
    """The same over a fixed number of long series."""
    return sql.replace(SHORT_KEY, key)


FITTED = query(
    [*SCORED, *bred(0, "pop0", SMALL), *evaluated(1, "pop1"), *bred(1, "pop1", SMALL), *evaluated(2, "pop2"),
     f"best AS (SELECT {WHO}, var, cuts, round(fitness, 4) AS fitness FROM pop2 JOIN rank2 USING ({WHO}) WHERE rank = 0)"],
    f"SELECT {ID}, var::INTEGER AS var, pos::INTEGER AS pos, round(cut, 9) AS cut, fitness, 10::INTEGER AS max_price_set,"
    " 10::INTEGER AS max_item_set FROM (SELECT *, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS pos FROM best)",
)

ORACLES: dict[str, str] = {
    "read_observations": (
        "SELECT l_shipdate AS timestamp, l_suppkey || '/' || year(l_shipdate) AS symbol, l_extendedprice AS price,"
        " l_quantity AS roc, l_discount AS stod, l_tax AS kdj, l_linenumber::DOUBLE AS macd FROM lineitem"
    ),
    "read_folders": (
        "SELECT l_shipdate AS timestamp, l_suppkey || '/' || year(l_shipdate) AS symbol, l_extendedprice AS price,"
        " l_quantity AS roc, l_discount AS stod, l_tax AS kdj, l_linenumber::DOUBLE AS macd FROM lineitem WHERE l_suppkey IN (3, 7)"
    ),
    "derive_series_key": query([OBS], "SELECT key, count(*) AS n FROM obs GROUP BY key"),
    "index_series": query(WHOLE, f"SELECT key, i, ts, {VALUES} FROM series"),
    "series_keys": query([OBS], "SELECT DISTINCT key FROM obs"),
    "find_series": query(WHOLE, f"SELECT key, i, ts, {VALUES} FROM series WHERE key = '1/1998'"),
    "filter_series": query(
        WHOLE, "SELECT key, i, v0 FROM series WHERE key IN (SELECT key FROM series GROUP BY key HAVING max(v0) > 104000)"
    ),
    "assemble_by_time": query(WHOLE, f"SELECT key, i::INTEGER AS i, {VALUES} FROM series"),
    "assemble_by_var": query(WHOLE, f"SELECT key, var, i::INTEGER AS i, value FROM ({LONG})"),
    "transpose_series": query(
        WHOLE,
        f"SELECT key, var, count(*)::INTEGER AS n, round(sum(value), 4) AS total FROM ({LONG}) GROUP BY key, var",
    ),
    "series_range": query([*WHOLE, *ranges("series")], "SELECT key, lo, hi FROM ranges"),
    "series_stats": query(WHOLE, f"SELECT key, count(*) AS n, {STATS} FROM series GROUP BY key"),
    "change_rate": query([*WHOLE, rates("series")], "SELECT key, i, round(rate, 9) AS rate FROM series_rate"),
    "init_cuts_uniform": query([*FIT, *ranges("train"), *population(UNIFORM)], listed("pop0")),
    "model_keys": query([*FIT, *ranges("train"), *population(RANDOM)], "SELECT DISTINCT key FROM pop0"),
    "init_cuts_random": query([*FIT, *ranges("train"), *population(RANDOM)], listed("pop0")),
    "discretize": query(LABELS, f"SELECT {ID}, var::INTEGER AS var, i, a AS label FROM un_a"),
    "align_covariates": query(
        LABELS,
        f"SELECT {ID}, var::INTEGER AS var, CASE WHEN var > 0 THEN i - 1 ELSE i END AS i, a AS label FROM un_a"
        " WHERE var = 0 OR i > 0",
    ),
    "interval_midpoints": query(
        [*models(RANDOM, FIT), *labels("tr", "train", "models", True), *rules("rules", "tr"),
         *forecast("fc", "train", "models", "rules", "tr", MULTIORDER)],
        f"SELECT {ID}, j::INTEGER AS j, round(mid, 9) AS mid FROM fc_m",
    ),
    **{f"rules_uni_o{o}": _rules(f"var = 0 AND ord = {o}") for o in (1, 2, 3)},
    **{f"rules_var_o{o}": _rules(f"var = 1 AND ord = {o}") for o in (1, 2, 3)},
    "mine_all_rules": _rules(),
    "forecast_uni": _rates_of(UNI, "unguarded"),
    "forecast_multivar": _rates_of(MULTIVAR),
    "forecast_multiorder": _rates_of(MULTIORDER),
    "forecast_multiorder_by_label": _rates_of(MULTIORDER, "by_label"),
    "forecast_by_variable": _rates_of(MULTIORDER, extra="var"),
    "price_from_rate": _price(False),
    "price_from_rate_fraction": _price(False, "1"),
    "price_from_rate_head": _price(True),
    "rmse_train": query(
        [*models(UNIFORM, FIT), *evaluated(0, "models")],
        f"SELECT {ID}, round(fitness, 4) AS rmse FROM fit0",
    ),
    "rmse_test": query(
        [*_model_forecast(MULTIORDER), prices("priced", "fc", "test"),
         with_head("shown", "priced", "test", "models"), rmse("scores", "shown")],
        f"SELECT {ID}, round(rmse, 4) AS rmse FROM scores",
    ),
    "score_models": _scores(f"SELECT {ID}, round(rmse, 4) AS rmse FROM scores"),
    "score_models_aligned": _scores(f"SELECT {ID}, round(rmse, 4) AS rmse FROM scores", "by_label", True, "1"),
    "mean_score": _scores(MEANS),
    "report_sorted": _scores(MEANS + " ORDER BY key"),
    "report_slice_mean": _scores(
        "SELECT round(avg(rmse), 4) AS slice_mean FROM (SELECT rmse, row_number() OVER (ORDER BY key) AS place"
        " FROM means) WHERE place BETWEEN 2 AND 10"
    ),
    "write_scores": _scores(MEANS),
    "evaluate_population": query(SCORED, BY_FITNESS),
    "evaluate_population_batch": query(SCORED, BY_FITNESS),
    "select_elite": query(
        SCORED,
        "SELECT key, model::INTEGER AS model, ind::INTEGER AS ind, rank::INTEGER AS rank,"
        f" round(fitness, 4) AS fitness FROM rank0 WHERE rank < {SMALL.elite}",
    ),
    "tournament_select": query(
        [*SCORED, *couples(0, SMALL, 0)], f"SELECT {ID}, pair::INTEGER AS pair, parent1, parent2 FROM cpl0"
    ),
    "single_point_crossover": query(
        [*FIT, *ranges("train"), *population(SMALL),
         f"pairs AS (SELECT DISTINCT key, model, ind AS pair, ind AS parent1, (ind + 1) % {SMALL.population} AS parent2 FROM pop0)",
         *children(0, "pop0", "pairs", CROSSING, 0)],
        listed("kids0"),
    ),
    "crossover_population": query(CROSSED, listed("kids0")),
    "mutate_population": query(
        [*FIT, *ranges("train"), *population(SMALL), mutated("mut", "pop0", SMALL, 0)], listed("mut")
    ),
    "repair_cuts": query([*CROSSED, *repaired("rep", "kids0", 0)], listed("rep")),
    "repair_cuts_first": query([*CROSSED, *repaired_first("rep", "kids0")], listed("rep")),
    "trim_cuts": query([*CROSSED, *trimmed("tri", "kids0", SMALL, 0)], listed("tri")),
    "next_generation": query([*SCORED, *bred(0, "pop0", SMALL)], listed("pop1")),
    "fit_cuts": FITTED,
    "train_series": FITTED,
    "train_series_price": FITTED_PRICE,
    "train_series_custom": query([*FIT, *ranges("train"), *population(UNIFORM)], listed("(SELECT * FROM pop0 WHERE ind = 0)", "key, model")),
    "train_series_with": query(
        WHOLE,
        "SELECT key, 1::INTEGER AS model, var::INTEGER AS var, pos::INTEGER AS pos, round(cut, 9) AS cut FROM ("
        "SELECT key, 0 AS var, 0 AS pos, 0::DOUBLE AS cut FROM series GROUP BY key"
        + "".join(f" UNION ALL SELECT key, {k}, {j}, {f}(v{k}) FROM series GROUP BY key" for k in (1, 2) for j, f in enumerate(("min", "max")))
        + ")",
    ),
    "train_series_streamed": long_series(
        query([*FIT, *ranges("train"), *population(UNIFORM)], listed("(SELECT * FROM pop0 WHERE ind = 0)", "key, model")), "l_returnflag AS key"),
}

ORACLES |= {
    "stored_series": ORACLES["find_series"],
    "filter_by_run": query([*WHOLE, *falling("series")], "SELECT key, i, v0 FROM series WHERE key IN (SELECT key FROM runs WHERE run >= 6)"),
    "longest_run": query([*WHOLE, *falling("series")], "SELECT key, run FROM runs"),
    "filter_exists": query(
        WHOLE, "SELECT key, i, v0 FROM series WHERE key IN (SELECT key FROM series WHERE v0 > 104000 AND v1 = 50)"),
    "filter_forall": query(WHOLE, "SELECT key, i, v0 FROM series WHERE key NOT IN (SELECT key FROM series WHERE v0 <= 1000)"),
    "longest_run_blocks": long_series(query([*WHOLE, *falling("series")], "SELECT key, run FROM runs")),
    "forecast_multiorder_join": long_series(ORACLES["forecast_multiorder"]),
    **{f"{name}_blocks": long_series(ORACLES[name])
       for name in ("index_series", "mine_all_rules", "forecast_multiorder", "score_models", "evaluate_population")},
    "fit_cuts_blocks": FITTED,
}
