"""Rewriting over existing files leaves every document on disk once."""

from pyspark.sql import functions as F

from rulecast.llm import sharding


def test_fewer_shards_over_existing_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(i, f"text {i} " * 20, i % 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    docs.withColumn("shard", F.col("at")).write.partitionBy("shard").parquet(path)
    placed = sharding.reshard(docs, 3, F.col("at"))
    touched = sharding.rewrite_shards(docs, placed, path)
    assert {3, 4} <= {*touched}
    on_disk = {r["doc_id"]: r["shard"] for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == len(rows)
    assert on_disk == {r["doc_id"]: r["shard"] for r in placed.collect()}


def test_columns_named_like_the_helpers(spark, tmp_path):
    """No column is lost or mistaken for one of the rewriting's own."""
    path = str(tmp_path / "shards")
    names = ["shard", "_id", "_crc", "_copy", "id", "crc", "copy", "row", "a.b"]
    rows = [(i, f"text {i} " * 20, i % 5, *range(10, 10 + len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "at", *names])
    placed = sharding.reshard(docs, 3, F.lit(0))
    sharding.rewrite_shards(docs, placed, path)
    table = spark.read.parquet(path)
    assert table.columns == [*docs.columns, "_shard"]
    assert sorted(tuple(r)[:-1] for r in table.collect()) == rows
    assert {r["doc_id"]: r["_shard"] for r in table.collect()} == {r["doc_id"]: r["shard"] for r in placed.collect()}
