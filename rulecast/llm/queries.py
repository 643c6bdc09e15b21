"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, collocations, decontamination, embedding_dedup, jaccard_join, language_id, line_dedup, quality_classifier,
               quality_rules, sharding, substring_dedup, token_alignment, url_filter)

#: The published vocabulary that op1 encodes with, by its name in the tokenizers' folder.
VOCABULARY = "word_bpe_49k.json"
#: The two that op12 aligns.
SIDES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: (verdict, host, path prefix)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Parts of a host's name that put its pages on the list of op3.
LISTED_HOSTS = "(^|[.-])(ads|spam|casino|adult|pills|bets)([.-]|$)"
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def line_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of all pages on hosts with a listed name."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = url_filter.url_parts(pages).where(F.col("host").rlike(LISTED_HOSTS)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES)


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, one of which has a third of all documents, to equal bytes."""
    docs = _table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(SHARDS))
    return sharding.reshard(docs, SHARDS, old).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def jaccard_join_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 3, 90, 100)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def substring_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(_table(spark, sf_dir, "documents"))


def repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(_table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    pred = language_id.identify_languages(docs, ~F.coalesce(held_out, F.lit(False)))
    return pred.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(_table(spark, sf_dir, "documents"), *map(vocabulary_path, SIDES))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": bpe_encode_decode,
    "op2_line_dedup": line_dedup_report,
    "op3_url_filter": url_filters,
    "op4_sharding": shard_documents,
    "op5_jaccard_join": jaccard_join_components,
    "op6_quality_classifier": quality_scores,
    "op7_substring_dedup": substring_dedup_report,
    "op8_quality_rules": repetition_rules,
    "op9_language_id": languages,
    "op10_decontamination": benchmark_hits,
    "op11_collocations": phrase_collocations,
    "op12_token_alignment": tokenizer_alignment,
    "op13_embedding_dedup": embedding_copies,
}
