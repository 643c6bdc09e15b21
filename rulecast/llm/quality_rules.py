"""Quality rules on repetition, by suffix arrays of words.

All texts of a batch are one sequence of word numbers with a separator of its own after
each text. Prefix doubling (numpy sorts of rank pairs; a suffix that is unique is not
sorted again) gives the suffix array and the ranks of every level, and these give the
longest common prefix of neighbours. A position's longest repeat is the larger of its two
neighbours' values: the longest common-prefix interval that holds it, so the union of
[i, i + longest) over longest >= 5 is the union of all maximal repeated word sequences of
five words or more.

Edges: null and blank texts have no words and fail; long texts are whole in one batch.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WINDOW = 5  # words of a repeat that counts
BATCH_WORDS = 400_000  # texts are gathered until they have so many words
MIN_WORDS = 10
MAX_COVERED = 20  # percent of words inside repeats
LONGEST_WORDS = 100  # a repeat of more words than this fails the text, however long that is
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, longest_repeat bigint")


def longest_repeats(codes: np.ndarray, word_counts: list[int]) -> np.ndarray:
    """For each word of the texts (all their numbers in ``codes``, text after text), the
    length of the longest sequence starting there that occurs again in the same text."""
    counts = np.asarray(word_counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    # Word numbers are made distinct between texts, so nothing matches across them.
    size = np.int64(codes.max()) + 1
    ranks, _ = _dense(text * size + codes, np.arange(total))
    ends = np.repeat(np.cumsum(counts), counts)
    levels, width = [ranks], 1
    active = _repeated(ranks, np.arange(total))
    while len(active):
        after = active + width
        inside = after < ends[active]
        second = np.where(inside, ranks[np.minimum(after, total - 1)] + 1, 0)
        ranks = _refine(ranks, active, second)
        levels.append(ranks)
        width *= 2
        active = _repeated(ranks, active)
    order = np.argsort(ranks, kind="stable")
    left, right = order[:-1], order[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        ok = (a < ends[left]) & (b < ends[right])
        ok &= levels[k][np.minimum(a, total - 1)] == levels[k][np.minimum(b, total - 1)]
        common += ok.astype(np.int64) << k
    out = np.zeros(total, np.int64)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _dense(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key: how many smaller ones there are."""
    order = np.argsort(keys, kind="stable")
    fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    return ranks, at


def _repeated(ranks: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Those positions of ``of`` that share their rank."""
    mine = ranks[of]
    return of[np.bincount(mine, minlength=len(ranks))[mine] > 1]


def _refine(ranks: np.ndarray, active: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks by (rank, second); only the active positions share ranks."""
    order = np.lexsort((second, ranks[active]))
    r, s = ranks[active][order], second[order]
    group = np.r_[True, r[1:] != r[:-1]]
    fresh = group | np.r_[True, s[1:] != s[:-1]]
    index = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(group, index, 0))
    offset = np.maximum.accumulate(np.where(fresh, index, 0)) - begin
    out = ranks.copy()
    out[active[order]] = r + offset
    return out


def _judge(texts: list[str], words: list[list[bytes]]) -> list[tuple]:
    numbers = dict.fromkeys(w for ws in words for w in ws)
    numbers = dict(zip(numbers, count()))
    counts = [len(ws) for ws in words]
    codes = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, sum(counts))
    longest = longest_repeats(codes, counts)
    ends = np.cumsum(counts)
    step = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(longest >= WINDOW)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    covered = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)]
    out = []
    for text, n, end in zip(texts, counts, ends):
        begin = end - n
        lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
        repeat = int(covered[end] - covered[begin])
        most = int(longest[begin:end].max()) if n else 0
        failed = n < MIN_WORDS or 100 * repeat > MAX_COVERED * n
        too_long = most > LONGEST_WORDS
        out.append((n, len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)),
                    len(lines) - len(set(lines)), repeat, failed, not failed and not too_long, most))
    return out


def judge_texts(texts: list[str | None]) -> list[tuple]:
    """The columns after doc_id for each text, in groups of about BATCH_WORDS words."""
    out: list[tuple] = []
    held: list[str] = []
    words: list[list[bytes]] = []
    n = 0
    for text in texts:
        held.append(text or "")
        words.append(held[-1].encode("utf-8", "surrogatepass").split())
        n += len(words[-1])
        if n >= BATCH_WORDS:
            out += _judge(held, words)
            held, words, n = [], [], 0
    return out + (_judge(held, words) if held else [])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document with the counts and verdicts of ``SCHEMA``. ``kept``: not
    base_failed, and no repeat of over LONGEST_WORDS words."""
    small_batches(docs.sparkSession)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = judge_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types))], names=names)

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text").mapInArrow(run, SCHEMA)
