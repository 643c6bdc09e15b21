"""BPE encoding and decoding as bounded-lookahead streaming transducers.

``BpeModel`` reads a tokenizer file of word-level BPE (lower-casing, NFC, end-of-word
suffix). Text is consumed in slices cut at white space. A word is emitted when it ends;
of a word longer than the buffer, those tokens are emitted that no continuation can
change: ``lookahead`` is computed from the merge list, and tokens that end at least so
many symbols before the end of what is known are final. Memory is constant besides
the text itself: one slice, one buffer, and caches of bounded size.

Why the bound holds: let two texts agree up to some symbol. Merges run by rank, and
while rank r is applied the tokens of both differ only right of some boundary b. The
boundary moves left only when a rule (u, v) joins the token u left of b in one of them,
and v there begins at b; so it moves by len(u), and v begins with the left part of the
rule that moved b before. Hence the farthest reach of a rule is len(u) plus the largest
reach of an earlier rule whose left part is a beginning of v.

Edges: null text counts as empty and gives no tokens; strings of the special tokens in
a text become those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Unicode white space, and the word pattern of the vocabulary file.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_PY_ONLY_BLANKS = re.compile("[\x1c-\x1f]")
_BLANK_RUN = re.compile(f"[{BLANKS}]+")

SLICE = 1 << 16  # characters consumed at a time
PIECE = 256  # longer pieces between blanks are not cached
CACHE_PIECES = 250_000
_NO_RULE = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """byte -> printable character: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Symbols after which a token end is final (see the module's text)."""
    size = lambda token: len(token) - len(suffix) + 1 if token.endswith(suffix) and suffix else len(token)
    reach: dict[str, int] = {}
    most = 0
    for left, right in merges:
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        here = size(left) + before
        if here > reach.get(left, 0):
            reach[left] = here
        most = max(most, here)
    return most + 1  # the last symbol itself may still take the suffix


class BpeModel:
    def __init__(self, definition: str):
        data = json.loads(definition)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        letters = byte_alphabet()
        self.inner = [vocab.get(letters[b]) for b in range(256)]
        self.final = [vocab.get(letters[b] + self.suffix) for b in range(256)]
        names = vocab | self.special
        self.token_text = {i: t.encode() for t, i in names.items()}
        back = {c: b for b, c in letters.items()}
        self.token_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in names.items()}
        #: Without a decoder in the file, token strings are joined by blanks.
        self.joined = data.get("decoder") is None
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.sizes = {i: max(1, len(t) - len(self.suffix) + 1 if self.suffix and t.endswith(self.suffix) else len(t)) for t, i in vocab.items()}
        self._pieces = _Pieces(self)
        self._words: dict[str, list[int]] = {}

    # -- encoding ----------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges, lowest rank first, leftmost first."""
        rank_of, joined, none = self.ranks.get, self.merged, _NO_RULE
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            ids[at:at + 2] = [joined[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(ids[at] << 32 | ids[at + 1], none)
        return ids

    def stream_word(self, word: bytes, buffer: int | None = None) -> Iterator[list[int]]:
        """Tokens of one word as they become final, with ``buffer`` (default twice the
        lookahead) symbols in memory."""
        buffer = buffer or 2 * self.lookahead
        held: list[int] = []
        last = len(word) - 1
        for at, b in enumerate(word):
            symbol = self.final[b] if at == last else self.inner[b]
            if symbol is not None:
                held.append(symbol)
            if at < last and len(held) >= buffer:
                tokens, done, end = self.merge(held[:]), 0, 0
                for token in tokens:
                    if end + self.sizes[token] > len(held) - self.lookahead:
                        break
                    end += self.sizes[token]
                    done += 1
                if done:
                    yield tokens[:done]
                    held = held[end:]
                else:  # a longer buffer is needed once
                    buffer *= 2
        if held:
            yield self.merge(held)

    def word_ids(self, word: str) -> list[int]:
        ids = self._words.get(word)
        if ids is None:
            if len(self._words) >= CACHE_PIECES:
                self._words.clear()
            raw = word.encode()
            if len(raw) > self.lookahead:
                return [t for part in self.stream_word(raw) for t in part]
            held = [self.inner[b] for b in raw]
            held[-1] = self.final[raw[-1]]
            ids = self._words[word] = self.merge([i for i in held if i is not None] if None in held else held)
        return ids

    def piece_ids(self, piece: str) -> list[int]:
        """Tokens of a text without blanks."""
        if piece.isascii() and piece.isalpha():  # one word as it is, whatever the Unicode version
            return self.word_ids(piece.lower())
        out: list[int] = []
        for part in self.special_split.split(piece) if self.special_split and "<" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
                continue
            # Lower-casing goes by character there: no final sigma.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in self.word.findall(part):
                out += self.word_ids(word)
        return out

    def encode_slices(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, one byte string for each slice of text."""
        for part in slices(text or ""):
            pieces = _BLANK_RUN.split(part) if _PY_ONLY_BLANKS.search(part) else part.split()
            yield b"".join(map(self._pieces.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode_slices(text)), "<u4").tolist()

    # -- decoding ----------------------------------------------------------

    def decode_slices(self, id_slices: Iterable[list[int]]) -> Iterator[str]:
        """Text of a stream of ids: bytes go through an incremental UTF-8 decoder, which
        keeps at most one unfinished character. Invalid bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        names, between = (self.token_text, b" ") if self.joined else (self.token_bytes, b"")
        first = True
        for ids in id_slices:
            if ids:
                chunk = between.join(map(names.__getitem__, ids))
                yield state.decode(chunk if first else between + chunk)
                first = False
        yield state.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_slices([ids]))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Count and digest of the ids and digest of their decoded text, slice by slice."""
        hashed, back, n = hashlib.sha256(), hashlib.sha256(), 0

        def ids() -> Iterator[list[int]]:
            nonlocal n
            for part in self.encode_slices(text):
                hashed.update(part)
                n += len(part) // 4
                yield np.frombuffer(part, "<u4").tolist()

        for out in self.decode_slices(ids()):
            back.update(out.encode())
        return n, hashed.hexdigest(), back.hexdigest()


class _Pieces(dict):
    """piece -> packed ids, bounded; long pieces are not kept."""

    def __init__(self, model: BpeModel):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.model.piece_ids(piece)).tobytes()
        if len(piece) <= PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of about ``size`` characters that end at white space (a longer run without
    any stays whole)."""
    at = 0
    while len(text) - at > size:
        blank = _BLANK_RUN.search(text, at + size)
        if blank is None:
            break
        yield text[at:blank.end()]
        at = blank.end()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def _model(definition: str) -> BpeModel:
    return BpeModel(definition)


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null is empty."""
    definition = _shared(docs, tokenizer_path)

    def run(batches):
        model = _model(definition.value)
        for batch in batches:
            rows = [model.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids: the tokens of every whole text; null gives an empty array."""
    definition = _shared(docs, tokenizer_path)

    def run(batches):
        model = _model(definition.value)
        for batch in batches:
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text").mapInArrow(
        run, "doc_id bigint, ids array<int>")


def decode_documents(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids; null ids give an empty text."""
    definition = _shared(tokens, tokenizer_path)

    def run(batches):
        model = _model(definition.value)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id AS bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def _shared(df: DataFrame, path: str):
    """The tokenizer file (a few MB, fixed) as a broadcast: executors need not have it."""
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())
