"""Evolution of cut points on a population table.

A population is one row per individual: ``(key, model, ind, c0..cK, lo, hi)``,
``model`` numbering independent repeats and ``lo``/``hi`` holding the value range
of every variable. A *scored* population also has ``fitness`` (smaller is
better), and offspring the ``known`` fitness of those that live on. Every step is a function of its input rows and of named draws, so a
retried task breeds the same offspring. The best ``elite`` individuals occupy
the indices below ``elite`` in the next generation and are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.draws import draw
from ..settle import spread
from .rules import Sets, cut_columns

#: Fitness is compared at so many significant digits, so that the order depends neither
#: on the order in which squared errors were summed nor on the scale of the prices.
FITNESS_DIGITS = 9


@dataclass(frozen=True)
class Search:
    """Settings of the search; the defaults are a full-size run."""

    repeats: int = 1
    generations: int = 100
    population: int = 200
    sets: Sets = field(default_factory=Sets)
    elite: int = 10
    tournament: int = 6
    crossover_rate: float = 0.8
    mutation_rate: float = 0.01
    seed: int = 0
    init: str = "uniform"

    def __post_init__(self):
        if not 0 < self.elite < self.population:
            raise ValueError("elite must be positive and smaller than the population")
        if not 0 < self.tournament < self.population:
            raise ValueError("tournament must be smaller than the population")
        if self.init not in ("uniform", "random"):
            raise ValueError("init must be 'uniform' or 'random'")
        if self.repeats < 1 or self.generations < 0:
            raise ValueError("need at least one repeat and no negative generations")


def _individuals(ranges: DataFrame, search: Search) -> DataFrame:
    return ranges.selectExpr("*", f"explode(sequence(1, {search.repeats})) as model").selectExpr(
        "*", f"explode(sequence(0, {search.population - 1})) as ind"
    )


def init_cuts_uniform(ranges: DataFrame, search: Search, variables: int) -> DataFrame:
    """Equal-width cuts inside the range of every variable, the same for all
    individuals. ``ranges`` comes from ``series_range``; ``variables`` = K+1."""
    cuts = [
        f"{iv.uniform_cuts(f'lo[{k}]', f'hi[{k}]', search.sets.limit(k))} as c{k}"
        for k in range(variables)
    ]
    return _individuals(ranges.selectExpr("key", *cuts, "lo", "hi"), search).select(
        "key", "model", "ind", *[f"c{k}" for k in range(variables)], "lo", "hi"
    )


def init_cuts_random(ranges: DataFrame, search: Search, variables: int) -> DataFrame:
    """Sorted uniform draws in the range of every variable."""

    def cuts(k: int) -> str:
        def draw_at(j: str) -> str:
            return draw(search.seed, "init", "key", "model", "ind", k, j)

        return iv.random_cuts(f"lo[{k}]", f"hi[{k}]", search.sets.limit(k), draw_at)

    return _individuals(ranges, search).selectExpr(
        "key", "model", "ind", *[f"{cuts(k)} as c{k}" for k in range(variables)], "lo", "hi"
    )


def init_population(ranges: DataFrame, search: Search, variables: int) -> DataFrame:
    start = init_cuts_uniform if search.init == "uniform" else init_cuts_random
    return start(ranges, search, variables)


#: Comparable fitness; an undefined one ranks last.
_RANKED = f"if(fitness is null, double('Infinity'), double(format_string('%.{FITNESS_DIGITS - 1}e', fitness)))"


def select_elite(scored: DataFrame, elite: int) -> DataFrame:
    """The ``elite`` best individuals per (key, model), with their ``rank`` (from
    0); equal fitness goes to the lower index."""
    best = Window.partitionBy("key", "model").orderBy(F.expr(_RANKED), "ind")
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(f"rank < {elite}")


def _pools(scored: DataFrame, search: Search) -> DataFrame:
    """One row per (key, model): its individuals in index order, each with its ``chance`` to
    win one tournament and where its part of the running sums begins. Ranks and sums are
    windows, linear in the population."""
    member = f"struct(ind, {', '.join(cut_columns(scored))}, fitness as score) as member"
    who = "partition by key, model"
    before = f"over ({who} order by ind rows between unbounded preceding and 1 preceding)"
    return (
        spread(scored, ["key"])
        .selectExpr("key", "model", "ind", f"{_RANKED} as fit", member, "lo", "hi")
        .selectExpr("*", f"rank() over ({who} order by fit) - 1 as better", f"count(*) over ({who}, fit) as equal")
        .selectExpr("*", f"{_chance(search)} as chance")
        .selectExpr("*", f"coalesce(sum(chance) {before}, 0D) as reach",
                    f"coalesce(sum(chance * (1 - chance)) {before}, 0D) as reach_one")
        .groupBy("key", "model")
        .agg(
            F.sort_array(F.collect_list(F.struct("ind", "fit", "chance", "reach", "reach_one", "member"))).alias("pool"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
        )
    )


def _chance(search: Search) -> str:
    """Chance to win one tournament. With k of n members drawn without replacement, the
    winner has rank r or worse in C(n-r, k) of C(n, k) cases; members of equal fitness share
    the chances of their ranks."""
    n, k = search.population, search.tournament

    def from_rank(r: str) -> str:
        return " * ".join(f"(greatest({n - i} - ({r}), 0) / {n - i}D)" for i in range(k))

    return f"({from_rank('better')} - {from_rank('better + equal')}) / equal"


def _hit(reach: str, spot: str, search: Search) -> str:
    """Position in ``pool`` of the member into whose part of ``reach`` the ``spot`` falls, by
    bisection."""
    further = f"get(pool, p + shiftleft(1, b)).{reach} <= spot"
    find = (
        f"aggregate(sequence({search.population.bit_length()}, 0, -1), 0, (p, b) -> "
        f"if(p + shiftleft(1, b) < size(pool) and {further}, p + shiftleft(1, b), p))"
    )
    return iv.once(spot, "spot", find)


def _couple(search: Search, gen: int) -> str:
    """Positions of two different parents in ``pool`` for ``pair``. Two tournaments that
    are repeated while they have the same winner give (a, b) with a weight of p(a) p(b),
    so a is drawn with p(a) (1 - p(a)) and b with p among the others: the part of a is
    jumped over."""

    def u(side: str) -> str:
        return draw(search.seed, side, "key", "model", gen, "pair")

    last = "element_at(pool, -1)"
    total = f"({last}.reach + {last}.chance)"
    total_one = f"({last}.reach_one + {last}.chance * (1 - {last}.chance))"
    one = _hit("reach_one", f"{u('a')} * {total_one}", search)
    apart = f"{u('b')} * ({total} - get(pool, a).chance)"
    jumped = iv.once(apart, "y", "if(y >= get(pool, a).reach, y + get(pool, a).chance, y)")
    return iv.once(one, "a", f"array(a, {_hit('reach', jumped, search)})")


def _pair_count(search: Search) -> int:
    return (search.population - search.elite + 1) // 2


def _couples(scored: DataFrame, search: Search, gen: int, with_elite: bool) -> DataFrame:
    """Parents of every pair; with the elite as pairs -elite..-1, best first."""

    def pair(number: str, a: str, b: str) -> str:
        return f"named_struct('pair', int({number}), 'a', get(pool, {a}).member, 'b', get(pool, {b}).member)"

    bred = iv.once(_couple(search, gen), "couple", pair("pair", "couple[0]", "couple[1]"))
    pairs = f"transform(sequence(0, {_pair_count(search) - 1}), pair -> {bred})"
    if with_elite:
        ranked = "sort_array(transform(pool, (m, p) -> struct(m.fit as fit, p as p)))"
        best = f"transform(slice({ranked}, 1, {search.elite}), (r, j) -> {pair(f'j - {search.elite}', 'r.p', 'r.p')})"
        pairs = f"concat({best}, {pairs})"
    return _pools(scored, search).selectExpr("key", "model", "lo", "hi", f"inline({pairs})").select(
        "key", "model", "pair", "a", "b", "lo", "hi"
    )


def tournament_select(scored: DataFrame, search: Search, gen: int = 0) -> DataFrame:
    """Both parents of every pair that fills the places above the elite:
    ``(key, model, pair, parent1, parent2)``, as indices."""
    return _couples(scored, search, gen, with_elite=False).selectExpr(
        "key", "model", "pair", "a.ind as parent1", "b.ind as parent2"
    )


def single_point_crossover(couples: DataFrame, search: Search, gen: int = 0) -> DataFrame:
    """Couples ``(key, model, pair, a, b, ...)`` with parents as structs
    ``(c0..cK)`` -> two children each, ``(key, model, ind, c0..cK, ...)``. Every
    variable has its own split in either parent; with probability
    1 - crossover_rate the children are copies of the parents. A negative pair
    number marks an elite member: ``a`` goes on unchanged to elite + pair, and if it has a
    ``score`` that is its ``known`` fitness."""
    names = [n for n in couples.schema["a"].dataType.names if n.startswith("c")]
    others = [c for c in couples.columns if c not in ("key", "model", "pair", "a", "b")]
    place = ("key", "model", gen, "pair")
    crossed = f"{draw(search.seed, 'cross', *place)} < double({search.crossover_rate!r})"
    splits = [
        f"{iv.split_point(f'{side}.{n}', draw(search.seed, f'split-{side}', *place, k))} as {side}_{n}"
        for side in ("a", "b")
        for k, n in enumerate(names)
    ]

    def child(one: str, two: str, offset: int) -> str:
        genes = ", ".join(
            f"if(crossed, {iv.cross(f'{one}.{n}', f'{two}.{n}', f'{one}_{n}', f'{two}_{n}')}, {one}.{n}) as {n}"
            for n in names
        )
        return f"struct({search.elite + offset} + pair * 2 as ind, {genes}{along}{unknown})"

    along = "".join(f", {c}" for c in others)
    kept = ", ".join(f"a.{n} as {n}" for n in names)
    known = unknown = ""
    if "score" in couples.schema["a"].dataType.names:
        known, unknown = ", a.score as known", ", cast(null as double) as known"
    unchanged = f"struct({search.elite} + pair as ind, {kept}{along}{known})"
    children = f"if(pair < 0, array({unchanged}), array({child('a', 'b', 0)}, {child('b', 'a', 1)}))"
    return (
        couples.selectExpr("*", f"{crossed} as crossed", *splits)
        .selectExpr("key", "model", f"inline({children})")
        .where(f"ind < {search.population}")
    )


def crossover_population(scored: DataFrame, search: Search, gen: int = 0) -> DataFrame:
    """Offspring for the places elite..population-1."""
    return single_point_crossover(_couples(scored, search, gen, with_elite=False), search, gen)


def _replace_cuts(population: DataFrame, elite: int, change) -> DataFrame:
    """``change(k, ck)`` in place of every cut array, for indices from ``elite``."""
    cuts = cut_columns(population)
    new = [f"if(ind >= {elite}, {change(k, c)}, {c}) as {c}" for k, c in enumerate(cuts)]
    others = [c for c in population.columns if c not in ("key", "model", "ind", *cuts)]
    return population.selectExpr("key", "model", "ind", *new, *others)


def mutate_population(population: DataFrame, search: Search, gen: int = 0) -> DataFrame:
    """Each variable of each non-elite individual is mutated with probability
    mutation_rate: insert a cut, change one by 10 to 50 percent, or remove one;
    then its cuts are sorted."""

    def mutated(k: int, c: str) -> str:
        def u(purpose: str) -> str:
            return draw(search.seed, purpose, "key", "model", gen, "ind", k)

        place = f"floor({u('place')} * size({c}))"
        shift = f"({u('size')} * 0.4D + 0.1D)"
        factor = f"if({u('sign')} < 0.5D, 1 - {shift}, 1 + {shift})"
        point = f"{u('point')} * (hi[{k}] - lo[{k}]) + lo[{k}]"
        new = (
            f"case int(floor({u('kind')} * 3)) when 0 then {iv.insert_cut(c, search.sets.limit(k), point)} "
            f"when 1 then {iv.change_cut(c, place, factor)} else {iv.remove_cut(c, place)} end"
        )
        return f"if({u('mutate')} < double({search.mutation_rate!r}), sort_array({new}), {c})"

    return _replace_cuts(population, search.elite, mutated)


def repair_cuts(population: DataFrame, mode: str = "shrinking", elite: int = 0) -> DataFrame:
    """Drop cuts too close to their right neighbour, for indices from ``elite``
    on. ``shrinking`` goes through all cuts, ``first`` drops the first one only."""
    if mode not in ("shrinking", "first"):
        raise ValueError("mode must be 'shrinking' or 'first'")
    repair = iv.repair_shrinking if mode == "shrinking" else iv.repair_first
    return _replace_cuts(population, elite, lambda _, c: repair(c))


def trim_cuts(population: DataFrame, search: Search, gen: int = 0) -> DataFrame:
    """Remove random cuts of non-elite individuals until every array is below
    its limit."""

    def trimmed(k: int, c: str) -> str:
        def draw_at(i: str) -> str:
            return draw(search.seed, "trim", "key", "model", gen, "ind", k, i)

        return iv.trim_random(c, search.sets.limit(k), draw_at)

    return _replace_cuts(population, search.elite, trimmed)


def next_generation(scored: DataFrame, search: Search, gen: int) -> DataFrame:
    """Elite, crossover, mutation, repair and trim in one pass over the scored
    population (one shuffle, to bring a (key, model) together)."""
    bred = single_point_crossover(_couples(scored, search, gen, with_elite=True), search, gen)
    bred = mutate_population(bred, search, gen)
    bred = repair_cuts(bred, "shrinking", search.elite)
    return trim_cuts(bred, search, gen)
