"""Near copies among vectors against comparing all pairs."""

import numpy as np
import pytest

import check
from __spark_entry__ import oracle_sql, queries
from rulecast.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, class int, n string"


def by_hand(rows, least=0.98):
    """vec_id -> (links, component) by all pairs; numbers are not repeated."""
    good = [(i, np.array(v, float), label) for i, v, label, *_ in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root = {i: i for i, *_ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, v, label) in enumerate(good):
        for j, w, other in good[:x]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (links[i], find(i)) for i in root}


def vectors(seed, alone, groups, dim=16, labels=2):
    """Vectors on their own, and groups of (size, noise) around a centre."""
    draw = np.random.default_rng(seed)
    rows = [draw.standard_normal(dim) for _ in range(alone)]
    labelled = [(v, int(draw.integers(labels))) for v in rows]
    for size, noise in groups:
        centre, label = draw.standard_normal(dim), int(draw.integers(labels))
        labelled += [(centre + noise * draw.standard_normal(dim), label) for _ in range(size)]
    order = draw.permutation(len(labelled))
    return [(n, [float(np.float32(x)) for x in labelled[i][0]], labelled[i][1], 1, "x") for n, i in enumerate(order)]


def found(spark, rows, **options):
    table = ed.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in table) and len(table) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in table}


def test_equals_all_pairs(spark):
    """Copies, pairs at the bound, a group larger than the window, chains."""
    rows = vectors(1, 400, [(2, 0.05)] * 30 + [(3, 0.14)] * 20 + [(150, 0.08), (90, 0.14), (40, 0.0)])
    assert sum(n for n, _ in by_hand(rows).values()) > 10_000
    assert found(spark, rows) == by_hand(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = vectors(2, 200, [(2, 0.1)] * 20 + [(120, 0.1), (30, 0.14)])
    monkeypatch.setattr(ed, "BLOCK", 70)
    monkeypatch.setattr(ed, "RANGE_ROWS", 100)
    monkeypatch.setattr(ed, "STRIP", 7)
    monkeypatch.setattr(ed.link_counts, "__defaults__", (0.98, 16))
    assert found(spark, rows) == by_hand(rows)


def test_odd_vectors(spark):
    one, inf = [1.0, 2.0, 3.0, -0.0], float("inf")
    rows = [(1, one, 1, 1, None), (2, [2.0, 4.0, 6.0, 0.0], 1, 1, None), (3, one, None, 1, None), (4, None, 1, 1, None), (5, [], 1, 1, None),
            (6, [0.0] * 4, 1, 1, None), (7, [1.0, None, 3.0, 0.0], 1, 1, None), (8, [1.0, inf, 3.0, 0.0], 1, 1, None),
            (9, [1.0, float("nan"), 3.0, 0.0], 1, 1, None), (10, [1.0, 2.0, 3.0], 1, 1, None), (11, one, 2, 1, None), (12, [x * 1e30 for x in one], 1, 1, None),
            (13, [1.0, 2.0, 3.0, 0.0], 1, 1, None)]
    want = by_hand(rows)
    again = found(spark, rows + [rows[0], (None, one, 1, 1, None), (None, None, 1, 1, None)])
    # the vector without a number is one more to the others of its label
    assert {i: x for i, x in again.items() if i is not None} == {i: (n + (c == 1), c) for i, (n, c) in want.items()}
    empty = spark.createDataFrame([], SCHEMA)
    assert ed.near_copies(empty).isEmpty()
    wide = spark.createDataFrame([(1, [1e200, 0.0], "a"), (2, [1e200, 1e199], "a"), (3, [-1e200, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["n_links"] for r in ed.near_copies(wide).collect()} == {1: 1, 2: 1, 3: 0}


def test_bound_is_exact():
    a = np.array([[1.0, 0.0], [0.98, np.sqrt(1 - 0.98**2)]])
    assert ed.near(a[:1], a[1:], 0.98 - 1e-15).all() and not ed.near(a[:1], a[1:], 0.98 + 1e-12).any()


def test_recall_at_the_bound(spark):
    """Lone pairs of just the bound's cosine, the hardest case, among many vectors of one label."""
    draw = np.random.default_rng(9)
    rows = []
    for n in range(3000):
        v, w = draw.standard_normal((2, 32))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        rows += [(2 * n, v.tolist(), 1, 1, None), (2 * n + 1, (0.9801 * v + np.sqrt(1 - 0.9801**2) * w).tolist(), 1, 1, None)]
    got = found(spark, rows)
    assert sum(got[2 * n + 1][1] == 2 * n for n in range(3000)) >= 2990


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries()["op13_embedding_dedup"](spark, path).toPandas()
    assert check.difference(got, check.connect(path).execute(oracle_sql()["op13_embedding_dedup"]).df()) is None
