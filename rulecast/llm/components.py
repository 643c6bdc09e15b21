"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, stored_alone


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``links`` (a, b).

    Each round gives an id the smallest label around it and then the label of that label,
    so paths shorten by jumps. Minima are combined before they move and the joins may be
    split by adaptive execution, so a node with very many links is no bottleneck.
    """
    return stored_alone(links.sparkSession, lambda: _components(links), "components")


def _components(links: DataFrame) -> DataFrame:
    links = links.where("a <> b")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = (both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b")
                  .groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near")))
        # What hangs below a node's label learns of a smaller one through that label.
        raised = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("near"))
        roots = raised.groupBy(F.col("label").alias("id")).agg(F.min("near").alias("root"))
        now = raised.join(roots.withColumnRenamed("id", "label"), "label").select("id", F.least("near", "root").alias("new"), F.col("label").alias("old"))
        jump = now.select(F.col("id").alias("new"), F.col("new").alias("beyond"))
        now = stored(now.join(jump, "new", "left").select("id", F.coalesce(F.least("new", "beyond"), F.col("new")).alias("label"), "old"), "labels")
        labels = now.select("id", "label")
        if now.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
