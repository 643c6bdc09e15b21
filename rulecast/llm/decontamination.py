"""Benchmark decontamination by a generalised suffix automaton.

The automaton of all normalised test items is fed the words of a document; the length of
the longest item passage that ends at each word is tracked. Where it reaches a window
(13 words, or a whole shorter item) the words of the window are hit. Words that no item
has reset the automaton, so only runs of item words are walked.

The automaton has at most two states a word. Items go to the workers in blocks of at most
``BLOCK_WORDS`` words, each block with its automaton; a benchmark of more words is matched
block after block, so what a task holds is bounded.

Edges: null or empty texts and items have no words; repeated items count once for each
item_id; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20

#: byte -> itself in a word (digits, a-z, everything beyond ASCII), lower-cased, or blank
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; ``windows_at`` tells which items' windows end in a state."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ends: list[tuple[int, int, int]] = []  # item, words, state of its prefix
        for item, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, word)
                if n >= min(window, len(words)):
                    ends.append((item, min(window, len(words)), last))
        #: state -> {window length: items}; the state is that of the window itself.
        self.items: dict[int, dict[int, set[int]]] = {}
        for item, size, state in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            self.items.setdefault(state, {}).setdefault(size, set()).add(item)
        #: Window states on the way from a state to the root, longest first.
        self.found: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.link)

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(at, word, there)
        return new

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, at: int, word: int, there: int) -> int:
        new = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        while at != -1 and self.next[at].get(word) == there:
            self.next[at][word] = new
            at = self.link[at]
        self.link[there] = new
        return new

    def _windows(self, state: int) -> tuple[tuple[int, int], ...]:
        """(window length, state) of all windows that end with the longest text of ``state``."""
        known = self.found[state]
        if known is None:
            above = self._windows(self.link[state]) if self.link[state] > 0 else ()
            own = tuple((size, state) for size in sorted(self.items.get(state, ()), reverse=True))
            known = self.found[state] = own + above
        return known

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, window length, items) of every window in ``words``."""
        state = size = 0
        moves, link, length = self.next, self.link, self.length
        for end, word in enumerate(words, 1):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            if word in moves[state]:
                state = moves[state][word]
                size += 1
            # The text matched here may be shorter than the longest of its state.
            for window, at in self._windows(state):
                if window <= size:
                    yield end, window, self.items[at][window]


class Benchmark:
    """One block of items, ready to match documents."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        numbered = []
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in item_words(text)]
            if words:
                numbered.append((item, words))
        self.least = min((min(window, len(w)) for _, w in numbered), default=0)
        self.automaton = SuffixAutomaton(numbered, window)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with occurring windows."""
        step = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        if self.least and len(words) >= self.least:
            get = self.numbers.get
            codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            known = np.flatnonzero(np.diff(np.r_[0, codes != 0, 0]))
            for begin, end in known.reshape(-1, 2).tolist():
                if end - begin >= self.least:
                    for at, size, found in self.automaton.matches(codes[begin:end].tolist()):
                        step[begin + at - size] += 1
                        step[begin + at] -= 1
                        items |= found
        return np.cumsum(step[:-1]) > 0, items


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_WORDS words (an item is never split). A test suite
    is small beside the corpus; it passes the driver as the automata's input."""
    blocks, n = [[]], 0
    for row in benchmark.selectExpr("item_id", "cast(text AS string) text").where("text IS NOT NULL").toLocalIterator():
        size = len(item_words(row["text"]))
        if n and n + size > BLOCK_WORDS:
            blocks.append([])
            n = 0
        blocks[-1].append((row["item_id"], row["text"]))
        n += size
    return blocks


def _matcher(docs: DataFrame, benchmark: DataFrame, window: int):
    """A function for workers: text -> (words, hit flags, items)."""
    small_batches(docs.sparkSession)
    blocks = [(uuid4().hex, docs.sparkSession.sparkContext.broadcast(b)) for b in item_blocks(benchmark)]

    def match(texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray, set[int]]]:
        words = [item_words(t) for t in texts]
        hit = [np.zeros(len(w), bool) for w in words]
        items: list[set[int]] = [set() for _ in words]
        for name, block in blocks:
            test = _block(name, block, window)
            for i, w in enumerate(words):
                flags, found = test.hits(w)
                hit[i] |= flags
                items[i] |= found
        return [*zip(words, hit, items)]

    return match


#: What this worker has built, by the block's name.
_BUILT: dict[str, Benchmark] = {}


def _block(name: str, block, window: int) -> Benchmark:
    if name not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[name] = Benchmark(block.value, window)
    return _BUILT[name]


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row per document: words, hit words, items met, and whether at least one in
    ``coverage`` words is hit."""
    match = _matcher(docs, benchmark, window)

    def run(batches):
        for batch in batches:
            found = match(batch.column(1).to_pylist())
            n = [len(w) for w, _, _ in found]
            hit = [int(h.sum()) for _, h, _ in found]
            digests = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for _, _, i in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(i) for _, _, i in found], pa.int64()), pa.array(digests, pa.string()),
                pa.array([h > 0 and coverage * h >= k for h, k in zip(hit, n)], pa.bool_()),
            ], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text").mapInArrow(run, SCHEMA)


def cut_spans(text: str, hit: np.ndarray) -> str:
    """``text`` without its hit words and what stands between two of them."""
    raw = text.encode("utf-8", "surrogatepass")
    edges = np.flatnonzero(np.diff(np.r_[False, _WORD[np.frombuffer(raw, np.uint8)], False].astype(np.int8))).reshape(-1, 2)
    kept, at = [], 0
    for is_hit, run in groupby(range(len(edges)), key=lambda i: bool(hit[i])):
        run = [*run]
        if is_hit:
            kept.append(raw[at:edges[run[0], 0]])
            at = int(edges[run[-1], 1])
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit spans of the others
    (``n_chars``, if there, follows the new text). All columns are returned."""
    match = _matcher(docs, benchmark, window)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = match(texts)
            keep = [not (h.any() and coverage * int(h.sum()) >= len(w)) for w, h, _ in found]
            new = [cut_spans(t, h) if k and h.any() else t for t, (_, h, _), k in zip(texts, found, keep)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out
