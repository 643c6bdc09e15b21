"""Line dedup: maximal repeated runs of lines, from a suffix array over line numbers.

Every non-blank line has an id (a digest of its words). Prefix doubling ranks the suffixes of
all documents' line sequences by their first line, then by two, four, ... lines: the rank of
a run is that of the pair of ranks of its halves, in sorted order. A suffix whose beginning
occurs once is sorted in already and leaves, so the rounds end at the longest repeated run.

The longest-common-prefix intervals are then found by bisection over the same ranks. Each
suffix that is a later copy at some width has one row: the width ``run`` that is proved,
and the earliest place ``first`` of the runs equal to it in that width, which names the
interval. From the widest rank down, the members of an interval (its rows and its first) are
split by the rank of what follows; a row with an earlier member in its part goes on in the
narrower, longer interval, the others stay. At the end ``run`` is exactly the longest run from
that line that also begins earlier, and rows with equal (run, first) are one interval. The
table never grows, and no step needs a whole interval in one task.

Such a run goes if it has ``min_lines`` lines, or ``long_words`` words over all its lines. Of
each interval the earliest place (doc_id, then line) stays.

Edges: null and blank texts have no lines; rows equal in doc_id and text are one document;
null ids rank last; a document is removed only if all its lines go; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, stored_alone
from .units import NO_ID, drop_units, keyed, text_units

MIN_LINES = 3
LONG_WORDS = 20

_PLACE = ["d", "th", "unit"]
_LATER = "struct(d, th, unit) > first"


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Suffixes (d, th, unit, words) with a rank by ``keys`` among those met at least twice,
    and the first place of their rank. Ranks keep the order of the keys, with gaps."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1").drop("n")
    ranks = stored(groups.orderBy(*keys).withColumn("new_rank", F.monotonically_increasing_id()), f"{name}-ranks")
    return stored(rows.join(ranks, keys).select(*_PLACE, "words", F.col("new_rank").alias("rank"), "first"), name)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """The repeated suffixes by their first 1, 2, 4, ... lines, to the longest repeated run."""
    # A document in several rows is read once.
    levels = [_ranked(lines.select(*_PLACE, "words", "h1", "h2").distinct(), ["h1", "h2"], "suffixes-1")]
    while not levels[-1].isEmpty():
        last, width = levels[-1], 1 << (len(levels) - 1)
        after = last.select("d", "th", (F.col("unit") - width).alias("unit"), F.col("rank").alias("next"), F.col("words").alias("more"))
        pairs = last.drop("first").join(after, _PLACE).withColumn("words", F.col("words") + F.col("more")).drop("more")
        levels.append(_ranked(pairs, ["rank", "next"], f"suffixes-{2 * width}"))
    return levels[:-1]


def _split(rows: DataFrame, level: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``run`` longer by ``width`` where the longer run begins earlier too."""
    firsts = rows.select("run", "first", "words").distinct().select(*[F.col(f"first.{c}") for c in _PLACE], "run", "words", "first")
    follows = level.select("d", "th", F.col("unit").alias("at"), F.col("rank").alias("next"), F.col("words").alias("more"))
    members = rows.unionByName(firsts).withColumn("at", F.col("unit") + F.col("run")).join(follows, ["d", "th", "at"], "left").drop("at")
    parts = members.where("next IS NOT NULL").groupBy("run", "first", "next").agg(F.min(F.struct(*_PLACE)).alias("nearer"))
    longer = (F.struct(*_PLACE) > F.col("nearer")) & F.col("next").isNotNull()
    return members.where(_LATER).join(parts, ["run", "first", "next"], "left").select(
        *_PLACE,
        F.when(longer, F.col("run") + width).otherwise(F.col("run")).alias("run"),
        F.when(longer, F.col("words") + F.col("more")).otherwise(F.col("words")).alias("words"),
        F.when(longer, F.col("nearer")).otherwise(F.col("first")).alias("first"))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """d, th, unit, run, words, first for every line that has an earlier copy: the lines and words
    of the longest run from there that begins earlier too, and the earliest place of that run."""
    spark = lines.sparkSession

    def find() -> DataFrame:
        levels = suffix_ranks(lines)
        runs = None
        for j in reversed(range(len(levels))):
            copies = levels[j].where(_LATER).select(*_PLACE, F.lit(1 << j).alias("run"), "words", "first")
            if runs is not None:
                copies = _split(runs, levels[j], 1 << j).unionByName(copies.join(runs.select(*_PLACE), _PLACE, "left_anti"))
            runs = stored(copies, f"runs-{1 << j}")
        if runs is None:
            place = "struct<d: bigint, th: bigint, unit: int>"
            runs = spark.createDataFrame([], f"d bigint, th bigint, unit int, run int, words int, first {place}")
        return runs

    return stored_alone(spark, find, "runs")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> tuple[DataFrame, DataFrame]:
    """All lines (see units.text_units), and the lines to remove: d, th, unit and ``run``, the
    lines of the run that takes them out and begins there (else null)."""
    lines = stored(text_units(docs, "line", fold=False), "lines")
    goes = (F.col("run") >= min_lines) | (F.col("words") >= long_words)
    marked = repeated_runs(lines).select(*_PLACE, F.when(goes, F.col("run")).alias("run"))
    # Every line of a repeated run has an earlier copy itself, so it is in this table.
    so_far = Window.partitionBy("d", "th").orderBy("unit")
    reach = F.max(F.col("unit") + F.col("run")).over(so_far)
    return lines, stored(marked.withColumn("reach", reach).where("reach > unit").drop("reach"), "gone")


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, removed (line numbers among those, from 0,
    comma-joined) and longest_run (lines of the longest run removed) for every row of ``docs``."""
    lines, gone = repeated_lines(docs, min_lines, long_words)
    counts = lines.groupBy("d", "th").agg((F.max("unit") + 1).alias("n"))
    lists = gone.groupBy("d", "th").agg(F.sort_array(F.collect_set("unit")).alias("units"), F.max("run").alias("longest"))
    rows = keyed(docs.select("doc_id", "text")).select("d", "th")
    return rows.join(counts, ["d", "th"], "left").join(lists, ["d", "th"], "left").select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("units"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("units").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest_run"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` (all columns) without the later copies of repeated runs of lines."""
    _, gone = repeated_lines(docs, min_lines, long_words)
    return drop_units(docs, gone, "line")
