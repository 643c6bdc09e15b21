"""SQL expressions over cut-point arrays.

A cut array ``c`` of m points splits the real line into m+1 intervals. Cuts may
be unsorted (offspring of a crossover are), so a value's label is the index of
the *first* cut above it, not a binary-search position.

``sort_array`` sorts without the comparison function that ``array_sort`` calls for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

# Fixed value: the two open intervals reach this far beyond the outer cuts.
EDGE_OFFSET = 0.002
# Two neighbouring cuts closer than either bound are "too close".
MIN_GAP = 0.0005
MIN_RELATIVE_GAP = 0.1


def once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated one time."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Up to this many cuts a label is a compiled CASE, beyond it an array function.
UNROLLED_CUTS = 16


def label_of(cuts: str, value: str, most: int | None = None) -> str:
    """0-based index of the first cut strictly above ``value``; ``size(cuts)``
    if there is none; NULL for a NULL value. ``most`` states the greatest number
    of cuts, if known."""
    if most is not None and most <= UNROLLED_CUTS:
        tests = " ".join(f"when get({cuts}, {j}) > {value} then {j}" for j in range(most))
        return f"case when {value} is null then null {tests} else size({cuts}) end"
    above = f"concat(transform({cuts}, x -> x > {value}), array(true))"
    return f"if({value} is null, null, int(array_position({above}, true) - 1))"


def interval_midpoints(cuts: str, edge: float = EDGE_OFFSET) -> str:
    """m+1 interval centres; the two open intervals use ``edge``."""
    inner = (
        f"zip_with(slice({cuts}, 1, size({cuts}) - 1), slice({cuts}, 2, size({cuts})), "
        "(a, b) -> (b + a) / 2D)"
    )
    return (
        f"concat(array(element_at({cuts}, 1) - double({edge!r})), {inner}, "
        f"array(element_at({cuts}, -1) + double({edge!r})))"
    )


def uniform_cuts(low: str, high: str, max_set: int) -> str:
    """``max_set - 2`` equally spaced cuts strictly inside [low, high]."""
    return f"transform(sequence(1, {max_set - 2}), j -> {low} + ({high} - {low}) / {max_set - 1}D * j)"


def random_cuts(low: str, high: str, max_set: int, draw_at: Callable[[str], str]) -> str:
    """``max_set - 1`` sorted uniform draws in [low, high]; ``draw_at(j)`` is
    the j-th draw."""
    spots = f"transform(sequence(1, {max_set - 1}), j -> {draw_at('j')} * ({high} - {low}) + {low})"
    return f"sort_array({spots})"


def _too_close(cuts: str, i: str) -> str:
    here, following = f"get({cuts}, {i})", f"get({cuts}, {i} + 1)"
    return (
        f"(abs({following} - {here}) < double({MIN_GAP!r}) or "
        f"coalesce(abs(try_divide({following} - {here}, {here})) < double({MIN_RELATIVE_GAP!r}), false))"
    )


def repair_shrinking(cuts: str) -> str:
    """Drop every cut too close to its right neighbour. Each drop also moves the
    end of the inspected range one place left; cuts beyond it vanish, except the
    last one, which always stays. If one cut would be left, nothing changes."""
    fold = (
        f"aggregate(transform({cuts}, (x, i) -> i), "
        f"named_struct('kept', cast(array() as array<double>), 'end', size({cuts})), "
        "(s, i) -> case when i >= s.end - 1 then s "
        f"when {_too_close(cuts, 'i')} then named_struct('kept', s.kept, 'end', s.end - 1) "
        f"else named_struct('kept', array_append(s.kept, get({cuts}, i)), 'end', s.end) end, "
        f"s -> array_append(s.kept, element_at({cuts}, -1)))"
    )
    return once(fold, "r", f"if(size(r) > 1, r, {cuts})")


def repair_first(cuts: str) -> str:
    """Drop only the first cut that is too close to its right neighbour."""
    close = f"transform({cuts}, (x, i) -> i < size({cuts}) - 1 and {_too_close(cuts, 'i')})"
    return once(f"array_position({close}, true)", "at", f"filter({cuts}, (x, i) -> i + 1 <> at)")


def trim_random(cuts: str, max_set: int, draw_at: Callable[[str], str]) -> str:
    """Remove uniformly chosen cuts until fewer than ``max_set`` are left: the
    cuts with the smallest draws go, the others keep their order."""
    surplus = f"(size({cuts}) - {max_set - 1})"
    ranked = f"sort_array(transform({cuts}, (x, i) -> struct({draw_at('i')} as u, i as i)))"
    doomed = f"transform(slice({ranked}, 1, {surplus}), r -> r.i)"
    kept = once(doomed, "d", f"filter({cuts}, (x, i) -> not array_contains(d, i))")
    return f"if({surplus} > 0, {kept}, {cuts})"


def split_point(cuts: str, u: str) -> str:
    """A split in 1..size-1 (1 when there is a single cut)."""
    return f"int(1 + floor({u} * greatest(size({cuts}) - 1, 1)))"


def cross(left: str, right: str, left_split: str, right_split: str) -> str:
    """Head of ``left`` followed by the *sorted* tail of ``right``; the result as
    a whole may be unsorted."""
    tail = f"slice({right}, {right_split} + 1, size({right}))"
    return f"concat(slice({left}, 1, {left_split}), sort_array({tail}))"


def insert_cut(cuts: str, max_set: int, point: str) -> str:
    return f"if(size({cuts}) < {max_set}, array_append({cuts}, {point}), {cuts})"


def change_cut(cuts: str, at: str, factor: str) -> str:
    """Move one cut: out of its place, multiplied, to the end."""
    return once(
        f"int({at})", "p",
        f"array_append(filter({cuts}, (x, i) -> i <> p), get({cuts}, p) * {factor})",
    )


def remove_cut(cuts: str, at: str) -> str:
    gone = once(f"int({at})", "p", f"filter({cuts}, (x, i) -> i <> p)")
    return f"if(size({cuts}) > 2, {gone}, {cuts})"
