"""A stored table of indexed series, from which one series is read without the others.

The rows are sorted by (key, i) within folders by a hash of the key. A look-up names its folder,
so no other is listed, and the key is pushed to the files, whose statistics leave out all
row groups of other series. A long series is spread over several files of its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def write_series(series: DataFrame, path: str, buckets: int = 64) -> None:
    """Store an indexed series table (key, i, ...) below ``path``. The number of buckets is
    kept in the folder's name."""
    place = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    laid = series.withColumn(BUCKET, place).repartitionByRange(BUCKET, "key", "i").sortWithinPartitions(BUCKET, "key", "i")
    laid.write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/buckets={buckets}")


def open_series(spark: SparkSession, path: str) -> DataFrame:
    """The whole store as an indexed series table, with the columns of its folders."""
    return spark.read.parquet(path)


def stored_series(store: DataFrame, key: str) -> DataFrame:
    """The rows of one series of :func:`open_series`; an unknown key has none."""
    bucket = F.pmod(F.xxhash64(F.lit(key)), F.col("buckets")).cast("int")
    return store.where((F.col(BUCKET) == bucket) & (F.col("key") == key)).drop("buckets", BUCKET)
