"""Reading observations from tab-separated text, one folder per instrument."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settle import broadcast_if_small, settle

#: Columns of the text files, in order (fixed values).
TEXT_COLUMNS = ("date", "price", "roc", "stod", "kdj", "macd")
#: Columns of the observation table (fixed values).
OBSERVATION_SCHEMA = (
    "timestamp timestamp_ntz, symbol string, "
    "price double, roc double, stod double, kdj double, macd double"
)
#: Rows that one task writes into a folder.
ROWS_A_FILE = 1_000_000
#: The beginning of a folder's name as :func:`write_observations` makes it.
WRITTEN = "folder="


def derive_series_key(folder: Column, date_token: Column) -> Column:
    """``folder/year`` with the year as it is written in a y/m/d token."""
    return F.concat(folder, F.lit("/"), F.element_at(F.split(date_token, "/"), 1))


def read_observations(
    spark: SparkSession, path: str, rejects: bool = False, folders: list[str] | None = None
) -> DataFrame:
    """``(timestamp, symbol, price, roc, stod, kdj, macd)`` from the files
    ``path/<folder>/*`` on any Hadoop file system, all folders in one scan. With
    ``folders`` only these are listed and opened; names that aren't there have no rows.

    Lines are ``y/m/d`` without zero padding, then five numbers; further fields
    are ignored. A malformed line stops the job; with ``rejects=True`` such lines
    are returned instead, as ``(file, line)``, see :func:`skip_malformed` for
    the rows that are left.
    """
    parsed = _parse(spark, path, folders)
    if rejects:
        return parsed.where(~_sound()).select("file", "line")
    wrong = F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.col("line")))
    # a filter, so that no choice of columns and no count skips it
    return _shape(parsed.where(F.when(_sound(), F.lit(True)).otherwise(wrong.cast("boolean"))), F.col("day"))


def skip_malformed(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """:func:`read_observations` without the malformed lines."""
    return _shape(_parse(spark, path, folders).where(_sound()), F.col("day"))


def _existing(spark: SparkSession, path: str, folders: list[str]) -> list[str]:
    """Patterns of the files in these folders, as far as there are any."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    names = {WRITTEN + escaped(name) for name in folders}
    names |= {name for name in folders if not {":", "/"} & set(name)}  # no folder of its own has these
    patterns = [f"{path}/" + re.sub(r"([\\*?{}\[\]^,])", r"\\\1", n) + "/*" for n in sorted(names)]
    found = []
    for pattern in patterns:
        place = jvm.org.apache.hadoop.fs.Path(pattern)
        if place.getFileSystem(conf).globStatus(place):
            found.append(pattern)
    return found


def _parse(spark: SparkSession, path: str, folders: list[str] | None) -> DataFrame:
    path = path.rstrip("/")
    places = f"{path}/*/*" if folders is None else _existing(spark, path, folders)
    if places:
        lines = spark.read.text(places).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    else:
        lines = spark.createDataFrame([], "line string, file string")
    token = F.split("line", "\t")
    numbers = [
        F.get(token, F.lit(j)).try_cast("double").alias(name)
        for j, name in enumerate(TEXT_COLUMNS)
        if j > 0
    ]
    # the path is URL-encoded; a folder of write_observations reads "folder=value"
    folder = _url_decoded(F.element_at(F.split("file", "/"), -2))
    written = F.substring(folder, len(WRITTEN) + 1, 2**31 - 1)
    folder = F.when(folder.startswith(WRITTEN), _url_decoded(written)).otherwise(folder)
    date = F.get(token, F.lit(0))
    part = F.split(date, "/")
    year, month, dom = (F.get(part, F.lit(j)).try_cast("int") for j in range(3))
    zero = F.lit(0)
    day = F.try_make_timestamp_ntz(year, month, dom, zero, zero, zero)
    return lines.select(
        "file", "line", day.alias("day"), derive_series_key(folder, date).alias("symbol"), *numbers
    )


def _url_decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _sound() -> Column:
    fine = F.col("day").isNotNull()
    for name in TEXT_COLUMNS[1:]:
        fine = fine & F.col(name).isNotNull()
    return fine


def _shape(parsed: DataFrame, stamp: Column) -> DataFrame:
    return parsed.select(stamp.alias("timestamp"), "symbol", *TEXT_COLUMNS[1:])


def to_series_form(
    observations: DataFrame,
    timestamp: str = "timestamp",
    key: str = "symbol",
    values: tuple[str, ...] = TEXT_COLUMNS[1:],
) -> DataFrame:
    """Any table with a time, a key and value columns as ``(key, ts, v0..vK)``;
    the first value column is the forecast target."""
    return observations.select(
        F.col(key).alias("key"), F.col(timestamp).alias("ts"),
        *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)],
    )


def write_observations(
    observations: DataFrame, path: str, values: tuple[str, ...], rows_a_file: int = ROWS_A_FILE
) -> None:
    """Write ``(folder, ts, values...)`` in the text form that
    :func:`read_observations` reads, one folder per instrument. The rows of a folder are
    counted and dealt by their hash, a part for each ``rows_a_file`` of them (equal lines together)."""
    date = F.concat_ws("/", F.year("ts"), F.month("ts"), F.day("ts"))
    line = F.concat_ws("\t", date, *[F.col(v).cast("string") for v in values])
    lines = observations.select("folder", line.alias("value"))
    sizes = settle(
        lines.groupBy("folder").count().where(f"count > {rows_a_file}")
        .selectExpr("folder", f"ceil(count / {rows_a_file}) as tasks")
    )
    dealt = lines.join(broadcast_if_small(sizes, sizes.count()), "folder", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("value"), F.col("tasks")), F.lit(0))
    dealt.repartition("folder", piece).select("folder", "value").write.partitionBy("folder").text(path)
