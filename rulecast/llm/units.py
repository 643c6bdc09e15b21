"""Lines and paragraphs of texts as rows, and texts without some of them.

A document's key is (d, th): its doc_id (null: the largest long) and a hash of its text.
Rows equal in both are one document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

NO_ID = (1 << 63) - 1
MARK_BITS = 1 << 26  # of the table that says which documents may lose units (8 MB)
_SPLIT = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
SCHEMA = "d bigint, th bigint, unit int, begin int, end int, words int, h1 bigint, h2 bigint"


def _key() -> tuple[Column, Column]:
    text = F.col("text").cast("string")
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with d and th in front."""
    return docs.select(*_key(), "*")


def unit_spans(text: str, kind: str) -> list[tuple[int, int]]:
    """Begin and end (code points) of the units of ``text`` that aren't blank."""
    spans, at = [], 0
    for gap in _SPLIT[kind].finditer(text):
        spans.append((at, gap.start()))
        at = gap.end()
    spans.append((at, len(text)))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def text_units(docs: DataFrame, kind: str, fold: bool) -> DataFrame:
    """One row a unit: its number, place, word count and a 128-bit digest of its words
    joined by single blanks, lower-cased if ``fold``."""

    def run(batches):
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(8)]
            for d, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (a, b) in enumerate(unit_spans(text or "", kind)):
                    words = text[a:b].split()
                    plain = " ".join(words)
                    digest = xxhash.xxh3_128_intdigest((plain.lower() if fold else plain).encode("utf-8", "surrogatepass"))
                    halves = np.array([digest >> 64, digest & (1 << 64) - 1], np.uint64).view(np.int64)
                    for column, value in zip(rows, (d, th, n, a, b, len(words), *halves)):
                        column.append(value)
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    small_batches(docs.sparkSession)
    return keyed(docs.select("doc_id", "text")).select("d", "th", F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def without_units(text: str, kind: str, gone: list[int]) -> str:
    """``text`` without the units of these numbers and the break after each (for the last
    unit, the break before it)."""
    spans = unit_spans(text, kind)
    drop = set(gone)
    kept = [(a, b) for i, (a, b) in enumerate(spans) if i not in drop]
    if not kept:
        return ""
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        after = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if i not in drop:
            out.append(text[at if not out and i == 0 else a:after])
        at = after
    cleaned = "".join(out)
    return cleaned.rstrip("\n") if len(spans) - 1 in drop else cleaned


def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (d, th, ...) with ``maybe``: false for those whose (d, th) is not in ``keys``, true
    for all others and a few more, by a broadcast table of MARK_BITS bits. It never has more
    than MARK_BITS / 64 rows of 16 bytes, however many keys there are."""
    place = F.xxhash64("d", "th").bitwiseAND(F.lit(MARK_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(d, th) & 63 AS int))")
    table = stored(keys.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")
    met = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(table), "word", "left")
    return met.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def drop_units(docs: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """``docs`` without the units (d, th, unit) in ``gone``; documents that lose their last
    unit go. All columns are returned, n_chars follows the text. Only documents that may lose
    something are shuffled."""
    small_batches(docs.sparkSession)
    names = docs.columns
    lists = gone.groupBy("d", "th").agg(F.sort_array(F.collect_set("unit")).alias("gone_units"))
    # the row as one column, so that no name of it meets those of the key
    keys = docs.select(*_key(), F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("row"))
    marked = maybe_among(keys, gone)
    met = marked.where("maybe").join(lists, ["d", "th"], "left").select("row", "gone_units")
    schema = docs.schema

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            columns = row.flatten()
            at = names.index("text")
            texts, lists = columns[at].to_pylist(), batch.column(1).to_pylist()
            new = [without_units(t, kind, g) if g and t else t for t, g in zip(texts, lists)]
            columns[at] = pa.array(new, columns[at].type)
            table = pa.RecordBatch.from_arrays(columns, names=names)
            yield table.filter(pa.array([not g or bool(t) for t, g in zip(new, lists)], pa.bool_()))

    out = met.mapInArrow(run, schema).union(marked.where("NOT maybe").select("row.*"))
    if "n_chars" in names:
        kind_of = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind_of))
    return out
