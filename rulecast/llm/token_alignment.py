"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that
puts a space before the text; both read the text with a space in front. Per batch, the
tokens of either side are a pandas table of document and byte place, and merge_asof, over places
that set the documents apart, finds for each token start the token of the other side that covers it. The union of
both directions are the overlaps. Where the covering token begins at the same byte, both
sides ended a token before, and a new group begins. Every token of A is linked with every
token of B in its group.

Links are counted by pairs of ids, distinct ones in a group with their number, so no group
is spelled out token by token. Spark counts the documents of each pair of ids; the table of
pairs is broadcast after it was counted, beyond PAIRS_SENT rows it is joined by a shuffle.

Edges: null and empty texts have no tokens, and so have texts that one side doesn't give back
byte for byte; each row is a document, repeated rows too; of several best partners all count.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import small_batches, stored

CACHE_WORDS = 300_000  # words whose ids a worker remembers,
CACHE_IDS = 8 * CACHE_WORDS  # and their ids
CHUNK = 1_000_000  # characters that are aligned at a time, if no single text is longer
PAIRS_SENT = 1_000_000  # pairs of ids (16 bytes each) that may be broadcast
SPELLED = 64  # links of a group that are written out before equal ones are counted

# Fixed value: how byte-level BPE divides a text into words, each of which is merged on its own.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters are divided here, as all tables of letters and blanks agree on
#: them: tab, line ends, printable ASCII, letters of Latin scripts, dashes and quotes.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u2010-\u2027]*")
#: WORDS for these texts, their letters, digits and blanks spelled out.
PLAIN_WORDS = re.compile(
    "'(?:[sdmt]|ll|ve|re)| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+".format(
        l="A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", n="0-9\u00b2\u00b3\u00b9\u00bc-\u00be", s="\t\n\r "))


class WordNumbers(dict):
    """word -> its number, given at its first look-up; ``new`` lists the words that got one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps all cores busy
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in byte_alphabet().items()}
        data = json.loads(definition)
        names = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in data["model"]["vocab"].items()}
        names |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
        self.a_bytes = _table([names.get(i, b"") for i in range(max(names) + 1)])
        self.b_bytes = _table([
            bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())])
        step = data.get("pre_tokenizer") or {}
        self.by_words = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not data.get("normalizer")
        self._forget()
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))

    def _forget(self):
        self.known = WordNumbers()
        self.ids, self.n_ids = np.empty(0, np.int64), np.empty(0, np.int64)  # of all known words, and how many of each

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A."""
        return [x.tolist() for x in self._encode_a(texts)]

    def _encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of A. The library merges a word once and not at each of its places, which are
        looked up as numbers and put together in one step for all texts."""
        divided = [(PLAIN_WORDS.findall(t) if PLAIN.fullmatch(t) else [t]) if self.by_words else [t] for t in texts]
        if len(self.known) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self._forget()
        words = np.array([len(x) for x in divided], np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(divided)), np.int64, int(words.sum()))
        if self.known.new:
            found = [x.ids for x in self.a.encode_batch_fast(self.known.new, add_special_tokens=False)]
            self.known.new = []
            self.n_ids = np.append(self.n_ids, [len(x) for x in found])
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int64))
        size = self.n_ids[number]
        ends = np.cumsum(size)
        at = np.repeat((np.cumsum(self.n_ids) - self.n_ids)[number] - (ends - size), size) + np.arange(size.sum())
        edges = np.append(0, ends)[np.cumsum(words)]
        return np.split(self.ids[at], edges[:-1]) if len(texts) else []

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none if either doesn't give back the bytes of space and text."""
        spaced = [" " + t for t in texts]
        out = []
        for text, a, b in zip(spaced, self._encode_a(spaced), self.b.encode(texts, num_threads=1)):
            b, plain = np.array(b, np.int64), text.encode()
            same = len(plain) > 1 and all(b"".join(table[ids].tolist()) == plain for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
            out.append((a, b) if same else (a[:0], b[:0]))
        return out


def _table(values: list[bytes]) -> np.ndarray:
    table = np.empty(len(values), object)
    table[:] = values
    return table


@lru_cache(maxsize=2)
def _tokenizers(definition: str, model: bytes) -> Tokenizers:
    return Tokenizers(definition, model)


class Alignment:
    """Tokens of some documents in one row of bytes, aligned.

    For sides a and b: ids, doc (number of the document), at (begin, from the first document's
    first byte), group (numbered through all documents); bases: where documents begin;
    overlaps: positions (a, b)."""

    def __init__(self, tokens: Tokenizers, texts: list[str]):
        encoded = tokens.encode(texts)
        sides = []
        for ids, sizes in (([a for a, _ in encoded], tokens.a_size), ([b for _, b in encoded], tokens.b_size)):
            flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
            ends = np.cumsum(sizes[flat])
            sides.append((flat, np.repeat(np.arange(len(ids)), np.array([len(x) for x in ids], int)), ends - sizes[flat], ends))
        (self.a, self.a_doc, self.a_at, self.a_end), (self.b, self.b_doc, self.b_at, self.b_end) = sides
        # Both sides of a document have the same bytes, so with a gap before each document a place
        # finds its own one, and no key of the documents is needed beside it.
        of_a = pd.DataFrame({"at": self.a_at + self.a_doc, "a": np.arange(len(self.a)), "a_at": self.a_at})
        of_b = pd.DataFrame({"at": self.b_at + self.b_doc, "b": np.arange(len(self.b)), "b_at": self.b_at})
        covers_a = pd.merge_asof(of_a, of_b, on="at")  # the token of B at each start in A
        covers_b = pd.merge_asof(of_b, of_a, on="at")
        self._found = covers_a[["a", "b"]], covers_b[["a", "b"]]
        self.a_group = np.cumsum(covers_a["b_at"].to_numpy() == self.a_at) - 1
        self.b_group = np.cumsum(covers_b["a_at"].to_numpy() == self.b_at) - 1

    def overlaps(self) -> pd.DataFrame:
        return pd.concat(self._found).drop_duplicates().sort_values(["a", "b"], ignore_index=True)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, linked ids of A and B, and the number of their links there, sorted."""
        if not len(self.a):
            return (np.empty(0, np.int64),) * 4
        ids_of_b = int(self.b.max()) + 1
        n_a, n_b = np.bincount(self.a_group), np.bincount(self.b_group)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        few = n_a * n_b <= SPELLED
        group = np.repeat(np.flatnonzero(few), (n_a * n_b)[few])
        nth = np.arange(len(group)) - np.repeat(np.cumsum((n_a * n_b)[few]) - (n_a * n_b)[few], (n_a * n_b)[few])
        one, two = first_a[group] + nth // n_b[group], first_b[group] + nth % n_b[group]
        docs, codes, times = [self.a_doc[one]], [self.a[one] * ids_of_b + self.b[two]], [np.ones(len(one), np.int64)]
        for g in np.flatnonzero(~few):
            a, of_a = np.unique(self.a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            b, of_b = np.unique(self.b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            codes.append((a[:, None] * ids_of_b + b).ravel())
            times.append((of_a[:, None] * of_b).ravel())
            docs.append(np.full(len(codes[-1]), self.a_doc[first_a[g]]))
        doc, code, number = (np.concatenate(x) for x in (docs, codes, times))
        by_pair = np.lexsort((code, doc)) if len(codes) > 1 else np.argsort(doc << 32 | code, kind="stable")
        doc, code, number = doc[by_pair], code[by_pair], number[by_pair]
        heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
        return doc[heads], *np.divmod(code[heads], ids_of_b), np.add.reduceat(number, heads)

    def spelled(self, marks: np.ndarray) -> list[bytes]:
        """Per document its groups: ids of A, a bar, ids of B; groups divided by semicolons."""
        ids = np.concatenate([self.a, self.b])
        group, side = np.concatenate([self.a_group, self.b_group]), np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, doc = group[order], side[order], np.concatenate([self.a_doc, self.b_doc])[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(order) else np.empty(0, bool)
        parts = marks[np.where(last, 1 + side, 0), ids[order]]
        edges = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else np.zeros(1, int)
        return [b"".join(parts[i:j].tolist())[:-1] for i, j in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def _marks(n: int) -> np.ndarray:
    """Decimal ids with a comma, a bar or a semicolon after them."""
    table = np.empty((3, n), object)
    for row, mark in zip(table, (",", "|", ";")):
        row[:] = [f"{i}{mark}".encode() for i in range(n)]
    return table


def _aligned(batches, files):
    """(rows' other columns, Alignment) for pieces of each batch of about CHUNK characters;
    the first column is the text."""
    tokens = _tokenizers(*files.value)
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at).columns[1:], tokens, Alignment(tokens, texts[at:end])
            at = end


def _files(docs: DataFrame, a_path: str, b_path: str):
    """The two files go to the tasks with the job, so that executors need no copy."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))


def token_overlaps(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per overlap of a token of A with one of B: doc_id, group, a and b (positions in
    the document, from 0), a_id, b_id, begin and end of the common bytes in space + text."""
    files = _files(docs, a_path, b_path)

    def run(batches):
        for (doc_ids,), _, al in _aligned(batches, files):
            pairs = al.overlaps()
            a, b = pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64)
            doc = al.a_doc[a]
            first = [np.searchsorted(x, np.arange(len(doc_ids))) for x in (al.a_doc, al.b_doc)]
            base, group = (np.append(x, 0)[first[0]] for x in (al.a_at, al.a_group))
            columns = (al.a_group[a] - group[doc], a - first[0][doc], b - first[1][doc], al.a[a], al.b[b],
                       np.maximum(al.a_at[a], al.b_at[b]) - base[doc], np.minimum(al.a_end[a], al.b_end[b]) - base[doc])
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, columns)], names=[
                "doc_id", "group", "a", "b", "a_id", "b_id", "begin", "end"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, group bigint, a bigint, b bigint, a_id bigint, b_id bigint, begin bigint, end bigint")


def linked_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked
    pairs of ids, each with the number of its links."""
    files = _files(docs, a_path, b_path)

    def run(batches):
        for (doc_ids,), tokens, al in _aligned(batches, files):
            n = len(doc_ids)
            n_a, n_b = (np.bincount(x, minlength=n) for x in (al.a_doc, al.b_doc))
            groups = np.bincount(al.a_doc[np.flatnonzero(np.diff(al.a_group, prepend=-1))], minlength=n)
            doc, one, two, times = al.pairs()
            links = np.zeros(n, np.int64)
            np.add.at(links, doc, times)
            offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            texts = al.spelled(_marks(max(len(tokens.a_size), len(tokens.b_size))))
            hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in texts + [b""] * (n - len(texts))]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)], pa.array(hashes),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((one, pa.int32()), (two, pa.int32()), (times, pa.int64()))]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_id", "b_id", "times"])

    return _rows(docs).mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "a_id array<int>, b_id array<int>, times array<bigint>")


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as
    any pair of its A id), count_sum (documents of the pair, over all links), groups_sha256."""
    row = F.monotonically_increasing_id().alias("row")
    rows = stored(linked_pairs(docs, a_path, b_path).select("*", row), "alignments")
    ids = rows.select(F.expr("inline(arrays_zip(a_id, b_id))"))
    counts = stored(ids.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    most = counts.groupBy("a_id").agg(F.max("docs").alias("most"))
    judged = counts.join(most, "a_id").select("a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("best"))
    if counts.count() <= PAIRS_SENT:
        judged = F.broadcast(judged)
    sums = rows.select("row", F.expr("inline(arrays_zip(a_id, b_id, times))")).join(judged, ["a_id", "b_id"]).groupBy("row").agg(
        F.sum(F.expr("if(best, times, 0)")).alias("n_best"), F.sum(F.expr("docs * times")).alias("count_sum"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")
