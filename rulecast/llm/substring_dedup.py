"""Substring dedup by hashing paragraphs and runs of lines.

The units of a text are its paragraphs (lines between blank ones) of at least
``paragraph_words`` words and its runs of up to ``run_lines`` lines with at least
``run_words`` words together: from each line on, and back from each line, the shortest that
has them. A long line is a run by itself, and a passage that was wrapped into short lines
is found by its runs. All units are normalised (lower-cased, white space made single),
digested, and grouped over all documents; the earliest by (doc_id, line) stays, the lines of
all others go, and their offsets in the original text are kept. The bounds count the words
of a whole unit; a text's shorter lines are no units, so that what many clean texts have in
common, as a heading, stays. Groups are counted before they move, so a unit in a third of
all documents is one row per task.

Edges: null and blank texts have no units; rows equal in doc_id and text are one document;
null ids rank last; a document whose lines all go is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .units import NO_ID, drop_units, keyed, unit_spans

PARAGRAPH_WORDS = 8
RUN_WORDS = 30
RUN_LINES = 8

_UNITS = "d bigint, th bigint, first int, last int, h1 bigint, h2 bigint"


def units_of(text: str, spans: list[tuple[int, int]], paragraph_words: int, run_words: int, run_lines: int) -> dict[tuple[int, int], str]:
    """(first line, last line) -> normalised text of each unit; ``spans`` are the lines."""
    words = [text[a:b].lower().split() for a, b in spans]
    total = np.cumsum([0, *map(len, words)]).tolist()
    found = set()
    begin = 0
    for i in range(len(spans)):
        # between two lines there are the break and the blank lines, if any
        if i + 1 == len(spans) or text.count("\n", spans[i][1], spans[i + 1][0]) > 1:
            if total[i + 1] - total[begin] >= paragraph_words:
                found.add((begin, i))
            begin = i + 1
        for last in range(i, min(i + run_lines, len(spans))):
            if total[last + 1] - total[i] >= run_words:
                found.add((i, last))
                break
        for first in range(i, max(i - run_lines, -1), -1):
            if total[i + 1] - total[first] >= run_words:
                found.add((first, i))
                break
    return {(i, j): " ".join(w for line in words[i:j + 1] for w in line) for i, j in found}


def _units(docs: DataFrame, paragraph_words: int, run_words: int, run_lines: int) -> DataFrame:
    names = [x.split()[0] for x in _UNITS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows: list[list[int]] = [[] for _ in names]
            for d, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                for (i, j), plain in units_of(text, unit_spans(text, "line"), paragraph_words, run_words, run_lines).items():
                    digest = xxhash.xxh3_128_intdigest(plain.encode("utf-8", "surrogatepass"))
                    halves = np.array([digest >> 64, digest & (1 << 64) - 1], np.uint64).view(np.int64)
                    for column, value in zip(rows, (d, th, i, j, *halves)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=names)

    return keyed(docs.select("doc_id", "text")).select("d", "th", F.col("text").cast("string")).mapInArrow(run, _UNITS)


def repeated_lines(docs: DataFrame, paragraph_words: int = PARAGRAPH_WORDS, run_words: int = RUN_WORDS, run_lines: int = RUN_LINES) -> DataFrame:
    """Lines (d, th, unit) in later copies of a unit."""
    small_batches(docs.sparkSession)
    units = stored(_units(docs, paragraph_words, run_words, run_lines), "units")
    place = F.struct("d", "th", "first")
    # Stored, so that the join reads two plain shuffles and a very common unit can be split.
    firsts = stored(units.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
                    .where("earliest <> latest").drop("latest"), "firsts")
    later = units.join(firsts, ["h1", "h2"]).where(place > F.col("earliest"))
    return stored(later.select("d", "th", F.explode(F.sequence("first", "last")).alias("unit")).distinct(), "gone")


def substring_report(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, n_units (lines), n_removed, chars_removed, removed_spans (begin-end offsets of the
    removed lines in the original text, in code points, comma-joined) for every row."""
    lists = repeated_lines(docs, **bounds).groupBy("d", "th").agg(F.sort_array(F.collect_set("unit")).alias("gone"))
    rows = keyed(docs.select("doc_id", "text")).select("d", "th", F.col("text").cast("string")).join(lists, ["d", "th"], "left")

    def run(batches):
        for batch in batches:
            spans, n = [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = unit_spans(text or "", "line")
                n.append(len(lines))
                spans.append([lines[i] for i in gone or []])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(map(len, spans), pa.int64()),
                 pa.array((sum(b - a for a, b in x) for x in spans), pa.int64()), pa.array(",".join(f"{a}-{b}" for a, b in x) for x in spans)],
                names=["doc_id", "n_units", "n_removed", "chars_removed", "removed_spans"])

    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return rows.select(doc_id, "text", "gone").mapInArrow(
        run, "doc_id bigint, n_units bigint, n_removed bigint, chars_removed bigint, removed_spans string")


def remove_repeated_units(docs: DataFrame, **bounds) -> DataFrame:
    """``docs`` (all columns) without the removed lines."""
    return drop_units(docs, repeated_lines(docs, **bounds), "line")
