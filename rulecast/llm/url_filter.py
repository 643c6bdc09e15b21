"""URL filters: rules by host and path, then a list of blocked URLs.

A blocked Bloom filter (one 512-bit block and eight bits a key) of the listed canonical
URLs lets possible hits pass; an exact hash join with the list removes its false
positives. The filter is built by Spark (bits are or-ed by block and word) and its size
is bounded: for lists beyond ``FILTER_KEYS`` keys it is left out and every URL takes the
exact join, which is right without it.

Edges: a null URL or one without ``://`` has empty host and path, fits no rule and is
not listed; repeated pages each get their row; an empty list blocks nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rulecast.settle import BROADCAST_ROWS

from .common import stored

BLOCK_WORDS = 8  # 64-bit words of a block
KEY_BITS = 8
BITS_PER_KEY = 16
FILTER_KEYS = 8_000_000  # 16 MB of filter

#: (action, host, path prefix)
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")


def url_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path to a table with a column url (replacing columns so named)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = pages.withColumn("url", url).withColumn("_rest", _rest(F.col("url")))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER)
    return rest.withColumn("host", host).withColumn(
        "path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def canonical_url() -> Column:
    """Of host and path: without scheme, query, fragment, user, port, a leading www., m.
    or blog., a closing slash or .html; null without a host."""
    host = F.regexp_replace(F.regexp_replace("host", r"^[^@]*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return F.when(F.col("host") != "", F.concat(host, F.regexp_replace("path", r"(\.html|/)$", "")))


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits host and path, else nulls."""
    text = action = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        text = F.when(fits, host + path) if text is None else text.when(fits, host + path)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def _positions(blocks: int) -> tuple[Column, Column]:
    """Block of a canonical URL, and the eight bit positions within it."""
    bits = F.array(*[F.expr(f"cast(shiftright(h2, {9 * i % 55}) & 511 AS int)") for i in range(KEY_BITS)])
    return F.expr(f"pmod(h1, {blocks}L)"), bits


def bloom_blocks(listed: DataFrame, keys: int) -> np.ndarray:
    """The filter of ``listed`` (canonical) as blocks x 8 words."""
    blocks = max(1, keys * BITS_PER_KEY // (64 * BLOCK_WORDS))
    block, bits = _positions(blocks)
    hashed = listed.selectExpr("xxhash64(canonical) h1", "xxhash64(canonical, 7) h2")
    words = (hashed.select(block.alias("block"), F.explode(bits).alias("bit"))
             .groupBy("block", F.expr("bit div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("mask")))
    table = words.toArrow()  # at most FILTER_KEYS keys' words
    out = np.zeros((blocks, BLOCK_WORDS), np.int64)
    out[table.column("block").to_numpy(), table.column("word").to_numpy()] = table.column("mask").to_numpy()
    return out


def possible_hits(urls: DataFrame, filter_blocks: np.ndarray) -> DataFrame:
    """``urls`` (any columns and h1, h2) with a boolean ``possible``."""
    shared = urls.sparkSession.sparkContext.broadcast(filter_blocks)
    schema = StructType([*urls.schema, StructField("possible", BooleanType())])

    def run(batches):
        table = shared.value
        for batch in batches:
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").to_numpy(zero_copy_only=False)
            rows = table[h1 % len(table)]
            hit = np.ones(len(h1), bool)
            for i in range(KEY_BITS):
                bit = (h2 >> (9 * i % 55)) & 511
                hit &= (rows[np.arange(len(h1)), bit >> 6] >> (bit & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "possible"])

    return urls.mapInArrow(run, schema)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages`` (page_id, url).

    ``listed``: blocked URLs (column url). Verdict: the action of the longest fitting
    rule; without one ``block`` if the canonical URL is listed, else ``allow``.
    """
    keys = stored(url_parts(listed.select("url")).select(canonical_url().alias("canonical"))
                  .where("canonical IS NOT NULL").distinct(), "listed-urls")
    n = keys.count()
    rule, action = rule_columns(rules)
    urls = (url_parts(pages.selectExpr("page_id", "url")).withColumn("canonical", canonical_url())
            .withColumn("rule", rule).withColumn("action", action)
            .drop("url").withColumn("h1", F.xxhash64("canonical")).withColumn("h2", F.expr("xxhash64(canonical, 7)")))
    urls = possible_hits(urls, bloom_blocks(keys, n)) if n <= FILTER_KEYS else urls.withColumn("possible", F.lit(True))
    urls = stored(urls.withColumn("possible", F.expr("possible AND canonical IS NOT NULL")).drop("h1", "h2"), "judged-urls")
    exact = keys.select("canonical", F.lit(True).alias("listed"))
    hits = urls.where("possible").join(F.broadcast(exact) if n <= BROADCAST_ROWS else exact.hint("shuffle_hash"), "canonical", "left")
    both = hits.unionByName(urls.where("NOT possible").withColumn("listed", F.lit(False)))
    return both.select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"))
