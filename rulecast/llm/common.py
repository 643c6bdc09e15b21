"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulecast.settle import discard, scratch_path

#: Ids (8 bytes each) that may be broadcast; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words a worker remembers before it starts its cache anew.
CACHE_WORDS = 100_000
#: Rows of an Arrow batch: texts are long, and both sides of the exchange hold a batch.
BATCH_ROWS = 500

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _M1
    return h ^ (h >> _S29)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of all runs of ``k`` words; of a shorter text
    its whole sequence; of no words none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = mix(h * _M2 + hashes[j:j + len(h)])
    return np.unique(h.view(np.int64))


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of non-blank characters (ASCII blanks only), A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: One cache a worker, for all operators.
HASHES = WordHashes()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold at most BATCH_ROWS rows (a smaller setting stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Folders that the innermost stored_alone under way has to delete.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back: no lineage is left
    and no executor holds the only copy."""
    path = scratch_path(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make(), name)``, and the tables that ``make`` stored on its way are deleted."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = stored(make(), name)
        path = made.pop()
    finally:
        _MADE.reset(token)
        for folder in made:
            discard(spark, folder)
    if (outer := _MADE.get()) is not None:
        outer.append(path)
    return out


def keep_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose doc_id is (or, with left_anti, is not) in the stored table
    ``ids``; broadcast only after counting it."""
    ids = ids.select("doc_id")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)
