"""The forecasting rules read plainly, in loops: what the Spark plans must give."""

from __future__ import annotations

import math
from collections import Counter


def rates(prices):
    return [(b - a) / a for a, b in zip(prices, prices[1:])]


def label(cuts, x):
    return next((j for j, c in enumerate(cuts) if c > x), len(cuts))


def midpoints(cuts, edge=0.002):
    inner = [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]
    return [cuts[0] - edge, *inner, cuts[-1] + edge]


def rules(antecedents, price, order):
    """Counts of (order labels, following price label)."""
    found = Counter()
    for start in range(len(price) - order):
        found[tuple(antecedents[start : start + order]), price[start + order]] += 1
    return found


def forecast(mids, tables, sources, price, consequent="by_position"):
    """``tables`` pairs (source index, order, counts); one rate per step."""
    out = []
    for i in range(len(price) - 1):
        up = down = 0.0
        for source, order, counts in tables:
            if i < order - 1:
                continue
            antecedent = tuple(sources[source][i - order + 1 : i + 1])
            for j, mid in enumerate(mids):
                wanted = j
                if consequent != "by_label":
                    if j >= len(price):
                        continue
                    wanted = price[j]
                if consequent != "unguarded" and not counts[antecedent, j]:
                    continue
                weight = counts[antecedent, wanted]
                up, down = up + weight * mid, down + weight
        out.append(up / down if down > 0 else 0.0)
    return out


def prices_from(rate, series, divisor=100.0):
    return [series[i + 1] * (1 + r / divisor) for i, r in enumerate(rate)]


def rmse(actual, predicted):
    return math.sqrt(sum((a - p) ** 2 for a, p in zip(actual, predicted)) / len(predicted))


def labelled(series, cuts, aligned):
    price = [label(cuts[0], r) for r in rates(series[0])]
    others = [[label(c, x) for x in v][1 if aligned else 0 :] for c, v in zip(cuts[1:], series[1:])]
    return price, others


def all_tables(others, price):
    return [(k, o, rules(v, price, o)) for k, v in enumerate(others) for o in (1, 2, 3)]


def fitness(series, cuts, **options):
    price, others = labelled(series, cuts, True)
    rate = forecast(midpoints(cuts[0]), all_tables(others, price), others, price, **options)
    return rmse(series[0][2:], prices_from(rate, series[0]))


def score(train, test, cuts, **options):
    price, others = labelled(train, cuts, True)
    tables = all_tables(others, price)
    now, seen = labelled(test, cuts, False)
    rate = forecast(midpoints(cuts[0]), tables, seen, now, **options)
    return rmse(test[0], test[0][:2] + prices_from(rate, test[0]))
