"""Near copies among vectors, by sorted projection passes.

In each pass a vector's key is the signs of KEY_BITS random projections, one after the other.
Spark sorts all vectors by group and key (several passes in one sort), numbers the places, and
compares every vector with the WINDOW before it; blocks of places share their edge. Pairs
of cosine ``least`` or more are verified in place, and a block passes on only as many as
connect its vectors. Their union over all passes gives the components.

Two vectors share long beginnings of their keys the more often the nearer they are: a pair of
cosine 0.98 differs in a bit with a chance of 6.4 %. So a pass of n vectors of a group
brings it within the window with a chance of about 0.936 ** log2(n / WINDOW), and PASSES
independent passes all miss it with (1 - that) ** PASSES.

A window cannot count the links of a large group of near copies, so links are counted
afterwards, within components: all members are compared in blocks, exactly and without rows
per pair. Equal vectors are one class with a number of members from the start, so that a
group of exact copies costs nothing.

Edges: vectors that are null, empty, zero, or hold nulls or numbers that aren't finite, and
those without a label, link with nothing, and so do vectors of different length; rows equal in
number and vector are one vector, each gets its row; rows that share only the number are
vectors of their own; a null number stands for no component.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulecast.operators.positions import numbered

from .common import small_batches, stored
from .components import connected_components

PASSES = 12
AT_ONCE = 4  # passes of one sort
KEY_BITS = 62
WINDOW = 64
RANGE_ROWS = 500_000  # rows of a range of the sort
BLOCK = 4096  # places that are compared by one task at a time
COMPARED = 2048  # members of a component that are one side of a block
STRIP = 64  # rows compared in one product
CLOSE = 1e-9  # cosines so near the bound are computed again without rounding in the sum


def projections(dim: int, some: range, seed: int) -> np.ndarray:
    """dim x (KEY_BITS for each pass of ``some``), the same on every executor."""
    return np.concatenate([np.random.default_rng([seed, dim, p]).standard_normal((dim, KEY_BITS)) for p in some], axis=1)


def _usable(values: np.ndarray) -> bool:
    return len(values) > 0 and bool(np.isfinite(values).all()) and bool(values.any())


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no square overflows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` (unit vectors) have a cosine of ``least`` or more."""
    cosine = x @ y.T
    out = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < CLOSE)):
        a, b = x[i].tolist(), y[j].tolist()
        dot = math.fsum(map(float.__mul__, a, b))
        out[i, j] = dot / math.sqrt(math.fsum(map(float.__mul__, a, a)) * math.fsum(map(float.__mul__, b, b))) >= least
    return out


def _described(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, digest and vec; those three are null where nothing can be linked."""
    wide = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(
        vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, number, dtype = ("float", pa.float32(), np.float32) if wide else ("double", pa.float64(), np.float64)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(f"array<{kind}>").alias("vec"))

    def run(batches):
        for batch in batches:
            dims, digests, vecs = [], [], []
            for label, vec in zip(batch.column(1), batch.column(2)):
                good = label.is_valid and vec.is_valid and vec.values.null_count == 0
                values = vec.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0) if good else np.empty(0, dtype)  # -0 is 0
                good = _usable(values)
                dims.append(len(values) if good else None)
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if good else None)
                vecs.append(values if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(vecs, pa.list_(number))],
                names=["vec_id", "label", "dim", "digest", "vec"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, f"vec_id bigint, label string, dim int, digest binary, vec array<{kind}>")


def _keys(classes: DataFrame, some: range, seed: int) -> DataFrame:
    """pass, key, class, dim and label of each class for the passes ``some``."""

    def run(batches):
        weights = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                signs = _unit(_matrix(batch.column(2).take(at))) @ projections(int(dim), some, seed) >= 0
                keys = signs.reshape(len(at), len(some), KEY_BITS) @ weights
                for p, key in zip(some, keys.T):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), pa.array(key), *[batch.column(c).take(at) for c in (0, 1, 3)]],
                        names=["pass", "key", "class", "dim", "label"])

    return classes.select("class", "dim", "vec", "label").mapInArrow(run, "pass int, key bigint, class bigint, dim int, label string")


def _blocks(rows: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """``work(rows of a block as an Arrow table)`` -> columns, for each block: the rows equal in
    ``keys``, which blocks of bounded size have. Sorted rows are streamed."""
    laid = rows.repartition(*keys).sortWithinPartitions(*rows.columns[:len(keys) + 1])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            begin = 0
            while begin < len(block):
                if block[begin] != now:
                    yield from out(held)
                    held, now = [], block[begin]
                end = begin
                while end < len(block) and block[end] == now:
                    end += 1
                held.append(batch.slice(begin, end - begin))
                begin = end
        yield from out(held)

    def out(held):
        if held:
            columns = work(pa.Table.from_batches(held).combine_chunks())
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return laid.mapInArrow(run, schema)


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _by_dim(dims: np.ndarray, vecs: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> (rows of that dim, their unit vectors)."""
    out = {}
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        out[int(dim)] = at, _unit(_matrix(vecs.take(pa.array(at))))
    return out


def window_links(rows: DataFrame, window: int, least: float) -> DataFrame:
    """Links (a, b) of ``rows`` (pos, pass, label, dim, class, vec): vectors of one pass and
    group at most ``window`` places apart, without those that follow from others of a block."""

    def work(table):
        number = lambda c: table.column(c).to_numpy()
        pos, own, names = number("pos"), number("own"), number("class")
        group = np.cumsum([True] * min(1, len(pos)) + [a != b for a, b in _neighbours(table, ("pass", "label", "dim"))])
        root = [*range(len(pos))]
        links = []
        for at, unit in _by_dim(number("dim"), table.column("vec").combine_chunks()).values():
            for begin in range(0, len(at), STRIP):
                here = at[begin:begin + STRIP]
                low = int(np.searchsorted(pos[at], pos[here[0]] - window))
                before = at[low:begin + STRIP]
                close = near(unit[begin:begin + STRIP], unit[low:begin + STRIP], least)
                close &= (group[here][:, None] == group[before]) & (pos[here][:, None] > pos[before])
                close &= (pos[here][:, None] - pos[before] <= window) & own[here][:, None]
                for i, j in zip(*np.nonzero(close)):
                    a, b = int(here[i]), int(before[j])
                    if (x := _find(root, a)) != (y := _find(root, b)):
                        root[x] = y
                        links.append((names[a], names[b]))
        return [x for x, _ in links], [y for _, y in links]

    spot = f"explode(if(pos % {BLOCK} >= {BLOCK - window}, array(pos div {BLOCK}, pos div {BLOCK} + 1), array(pos div {BLOCK}))) as block"
    spread = rows.selectExpr("*", spot).selectExpr(
        "block", "pos", f"pos div {BLOCK} = block as own", "pass", "label", "dim", "class", "vec")
    return _blocks(spread, ["block"], "a bigint, b bigint", work)


def _neighbours(table: pa.Table, names: tuple[str, ...]):
    values = list(zip(*(table.column(c).to_pylist() for c in names)))
    return zip(values, values[1:])


def linked_classes(classes: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 0) -> DataFrame:
    """Links (a, b) that connect the ``classes`` (class, label, dim, vec) found near each other."""
    if not 0 < window < BLOCK:
        raise ValueError(f"the window must be positive and below {BLOCK}")
    n = classes.count()
    links = []
    for first in range(0, passes, AT_ONCE):
        some = range(first, min(passes, first + AT_ONCE))
        ranges = -(-n * len(some) // RANGE_ROWS)
        order = ["pass", "label", "dim", "key"]
        placed = numbered(_keys(classes, some, seed), order, ranges).select("pos", "pass", "class", "label", "dim")
        rows = placed.join(classes.select("class", "vec"), "class")
        links.append(stored(window_links(rows, window, least), "near"))
    return reduce(DataFrame.union, links)


def link_counts(members: DataFrame, least: float = 0.98, side: int = COMPARED) -> DataFrame:
    """class, links: for each of ``members`` (component, class, n, dim, vec) the sum of n over
    the classes of its component that it links with. A component is compared in blocks of
    ``side`` x ``side``."""
    sizes = members.groupBy("component").agg(F.expr(f"ceil(count(*) / {side})").alias("parts"))
    part = F.expr("pmod(xxhash64(class), parts)").alias("part")
    placed = members.join(sizes, "component").select("component", "class", "n", "dim", "vec", "parts", part)
    spread = placed.select("*", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other")).selectExpr(
        "component", "least(part, other) as lo", "greatest(part, other) as hi", "class", "part", "n", "vec", "dim")

    def work(table):
        number = lambda c: table.column(c).to_numpy()
        names, weight, part, (lo,), (hi,) = number("class"), number("n"), number("part"), number("lo")[:1], number("hi")[:1]
        links = np.zeros(len(names), np.int64)
        for at, unit in _by_dim(number("dim"), table.column("vec").combine_chunks()).values():
            left, right = np.flatnonzero(part[at] == lo), np.flatnonzero(part[at] == hi)
            for begin in range(0, len(left), 4 * STRIP):
                rows = left[begin:begin + 4 * STRIP]
                close = near(unit[rows], unit[right], least)
                if lo == hi:
                    close &= rows[:, None] != right
                links[at[rows]] += close @ weight[at[right]]
                if lo != hi:
                    links[at[right]] += weight[at[rows]] @ close
        return names, links

    return _blocks(spread, ["component", "lo", "hi"], "class bigint, links bigint", work).groupBy("class").agg(F.sum("links").alias("links"))


def near_copies(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding,
    label): among vectors of equal label, the number of others with a cosine of ``least`` or
    more, the smallest vec_id reachable by such links, and whether that is its own."""
    rows = stored(_described(vectors), "vectors")
    group = ["label", "dim", "digest"]
    members = rows.where("digest IS NOT NULL").groupBy(*group, "vec_id").agg(F.first("vec").alias("vec"))
    classes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    found = connected_components(linked_classes(classes, least, passes, window, seed))
    near_ones = stored(found.withColumnRenamed("id", "class").join(classes, "class"), "components")
    named = near_ones.groupBy("component").agg(F.min("id").alias("component_id"))
    counts = link_counts(near_ones, least)
    judged = near_ones.select("class", "component").join(named, "component").join(counts, "class", "left").select(
        "class", "component_id", "links")
    about = classes.select(*group, "class", "n", "id").join(judged, "class", "left").select(
        *group, F.coalesce("component_id", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    component = F.coalesce("component", "vec_id")
    return rows.drop("vec").join(about, group, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
