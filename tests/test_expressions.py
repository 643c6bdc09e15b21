"""Worked-by-hand cases of the column expressions."""

import math

import pytest

from rulecast.functions import intervals as iv
from rulecast.functions.draws import draw


def value(spark, sql, cuts=None):
    table = spark.range(1)
    if cuts is not None:
        text = ", ".join(f"double({c!r})" for c in cuts)
        table = table.selectExpr(f"array({text}) as c")
    return table.selectExpr(f"{sql} as r").first()["r"]


@pytest.mark.parametrize("most", [None, 9])
def test_label_of_unsorted_cuts(spark, most):
    cuts = [0.1, 0.3, 0.2]
    for x, want in (("0D", 0), ("0.1D", 1), ("0.25D", 1), ("0.5D", 3), ("double('NaN')", 3)):
        assert value(spark, iv.label_of("c", x, most), cuts) == want
    assert value(spark, iv.label_of("c", "cast(null as double)", most), cuts) is None


def test_midpoints(spark):
    assert value(spark, iv.interval_midpoints("c"), [0.01, 0.03]) == pytest.approx([0.008, 0.02, 0.032])
    assert value(spark, iv.interval_midpoints("c"), [1.0]) == pytest.approx([0.998, 1.002])


def test_uniform_cuts(spark):
    assert value(spark, iv.uniform_cuts("0D", "9D", 10)) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert value(spark, iv.uniform_cuts("5D", "5D", 5)) == [5, 5, 5]


def test_repair(spark):
    cuts = [0.01, 0.0101, 0.02, 0.03, 0.05]
    assert value(spark, iv.repair_shrinking("c"), cuts) == [0.0101, 0.02, 0.05]
    assert value(spark, iv.repair_first("c"), cuts) == [0.0101, 0.02, 0.03, 0.05]
    assert value(spark, iv.repair_shrinking("c"), [1.0, 1.01]) == [1.0, 1.01]
    assert value(spark, iv.repair_first("c"), [1.0, 2.0]) == [1.0, 2.0]
    assert value(spark, iv.repair_shrinking("c"), [0.0, 1.0, 2.0]) == [0.0, 1.0, 2.0]
    assert value(spark, iv.repair_shrinking("c"), [3.0]) == [3.0]


def test_cross(spark):
    a, b = "array(1D, 2D, 3D)", "array(9D, 5D, 7D)"
    assert value(spark, iv.cross(a, b, "2", "1")) == [1, 2, 5, 7]
    assert value(spark, iv.cross(b, a, "1", "2")) == [9, 3]


def test_split_point_range(spark):
    assert value(spark, iv.split_point("c", "0D"), [1.0, 2.0, 3.0]) == 1
    assert value(spark, iv.split_point("c", "0.999D"), [1.0, 2.0, 3.0]) == 2
    assert value(spark, iv.split_point("c", "0.999D"), [1.0]) == 1


def test_mutations(spark):
    cuts = [1.0, 2.0, 4.0]
    assert value(spark, iv.insert_cut("c", 10, "3D"), cuts) == [1, 2, 4, 3]
    assert value(spark, iv.insert_cut("c", 3, "3D"), cuts) == cuts
    assert value(spark, iv.change_cut("c", "0", "1.5D"), cuts) == [2, 4, 1.5]
    assert value(spark, iv.remove_cut("c", "1"), cuts) == [1, 4]
    assert value(spark, iv.remove_cut("c", "1"), [1.0, 2.0]) == [1, 2]


def test_trim_keeps_order(spark):
    cuts = [float(j) for j in (5, 3, 9, 1, 7, 2, 8, 4, 6, 0)]
    kept = value(spark, iv.trim_random("c", 10, lambda i: draw(1, "t", i)), cuts)
    assert len(kept) == 9 and kept == [c for c in cuts if c in kept]
    assert value(spark, iv.trim_random("c", 11, lambda i: draw(1, "t", i)), cuts) == cuts


def test_draws_are_uniform_and_repeat(spark):
    drawn = [r[0] for r in spark.range(4000).selectExpr(draw(3, "x", "id")).collect()]
    again = [r[0] for r in spark.range(4000).repartition(7).orderBy("id").selectExpr(draw(3, "x", "id")).collect()]
    assert drawn == again
    assert 0 <= min(drawn) and max(drawn) < 1
    assert math.isclose(sum(drawn) / len(drawn), 0.5, abs_tol=0.02)
