"""Cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many (narrow) rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without one: there a fresh temporary folder is
    set. On a cluster a machine-local folder would be lost with its executor, so
    a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rulecast-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Used where a table feeds several branches of a plan or a driver loop would
    grow its lineage. The written rows outlive any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle_by(df: DataFrame, keys: list[str], path: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to ``path`` (of :func:`scratch_path`) in buckets by ``keys``, rows sorted by
    ``keys`` and ``order``. Unlike a checkpoint the table keeps its layout: joins and
    groupings by ``keys`` read it without a shuffle, as often as it is used. The name that
    a bucketed table needs is dropped at once; the files stay until :func:`discard`."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"settled_{uuid.uuid4().hex}"
    laid = df.repartition(buckets, *keys)  # no shuffle, if df is laid out so already
    laid.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose successor is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a counted side; otherwise leave the join to
    Spark (sort-merge, with adaptive skew handling)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash ``df`` by ``keys`` into ``spark.sql.shuffle.partitions`` partitions.

    For stages whose work per row is multiplied by the models tried on it:
    adaptive execution sizes partitions by bytes and would merge them into too
    few tasks. Spark drops the shuffle where ``df`` is already laid out so.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
