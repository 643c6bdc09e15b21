"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word (a run of letters, lower-cased, as UTF-8; longer ones in windows
of ``WINDOW`` bytes) in both directions and gives every byte position a distribution over
the languages. It is trained in numpy by backpropagation through time with the document's
language as every position's label. A document's probabilities pool those of all its
positions: the geometric mean decides, the arithmetic mean of the winner is the score.

Words are the recurrent context, so a word that a worker has met is not read again; its
memory is bounded (``CACHE_WORDS``). Training uses about ``SAMPLE_DOCS`` whole documents
of each language, chosen by a hash of their id.

Edges: null texts and texts without a letter are ``und`` with score 0; without any
training document every text is. Rows with a null language train nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE_DOCS = 250
WINDOW = 24
HIDDEN = 12
EMBED = 12
STEPS, BATCH, RATE = 700, 256, 0.01
CACHE_WORDS = 250_000
CHUNK_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_PAD = 256


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    words = _WORD.findall(text.lower())
    return words if not words or words[0].isalpha() or any(map(str.isalpha, "".join(words))) else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters: embedding, and for each direction input, state and bias weights of the
    update (z), reset (r) and candidate (c) gates; a linear layer on both states."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.4 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": draw(_PAD + 1, EMBED) * 4, "o": draw(2 * HIDDEN, classes), "ob": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"{d}w": draw(EMBED, 3 * HIDDEN), f"{d}u": draw(HIDDEN, 3 * HIDDEN), f"{d}b": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, codes: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) of one direction over codes (time, batch)."""
        h = np.zeros((codes.shape[1], HIDDEN), np.float32)
        out = np.empty((*codes.shape, HIDDEN), np.float32)
        table = self.p["e"] @ self.p[f"{d}w"] + self.p[f"{d}b"]
        u, n = self.p[f"{d}u"], HIDDEN
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            x, live = table[codes[t]], (codes[t] != _PAD)[:, None]
            g = _sigmoid(x[:, :2 * n] + h @ u[:, :2 * n])
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(x[:, 2 * n:] + (r * h) @ u[:, 2 * n:])
            new = np.where(live, h + z * (c - h), h)
            if trace is not None:
                trace.append((t, h, z, r, c, live))
            h = out[t] = new
        return out

    def probabilities(self, codes: np.ndarray, traces: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self._run(codes, d, None if traces is None else traces.setdefault(d, [])) for d in "fb"], axis=2)
        logits = states @ self.p["o"] + self.p["ob"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=2, keepdims=True), states

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients through time."""
        traces: dict[str, list] = {}
        probs, states = self.probabilities(codes, traces)
        live = codes != _PAD
        total = max(1, int(live.sum()))
        picked = np.take_along_axis(probs, np.broadcast_to(labels, codes.shape)[..., None], 2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * live).sum() / total)
        delta = probs.copy()
        np.put_along_axis(delta, np.broadcast_to(labels, codes.shape)[..., None], picked[..., None] - 1, 2)
        delta *= live[..., None] / np.float32(total)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = np.einsum("tbi,tbc->ic", states, delta)
        grads["ob"] = delta.sum((0, 1))
        back = delta @ self.p["o"].T
        n = HIDDEN
        for d, part in (("f", back[..., :n]), ("b", back[..., n:])):
            u, w = self.p[f"{d}u"], self.p[f"{d}w"]
            dh = np.zeros((codes.shape[1], n), np.float32)
            for t, h, z, r, c, alive in reversed(traces[d]):
                dh = dh + part[t]
                pass_on = np.where(alive, 0, dh)
                here = np.where(alive, dh, 0)
                dc = here * z * (1 - c * c)
                dz = here * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * n:].T
                dr = drh * h * r * (1 - r)
                dgates = np.concatenate([dz, dr], 1)
                grads[f"{d}u"][:, :2 * n] += h.T @ dgates
                grads[f"{d}u"][:, 2 * n:] += (r * h).T @ dc
                dx = np.concatenate([dgates, dc], 1)
                grads[f"{d}b"] += dx.sum(0)
                emb = self.p["e"][codes[t]]
                grads[f"{d}w"] += emb.T @ dx
                np.add.at(grads["e"], codes[t], dx @ w.T)
                dh = pass_on + here * (1 - z) + drh * r + dgates @ u[:, :2 * n].T
        return loss, grads

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 0) -> float:
        """Adam over random batches of the words' windows; returns the last mean loss."""
        parts = [(w[k:k + WINDOW], label) for w, label in zip(words, labels) for k in range(0, max(1, len(w)), WINDOW)]
        words, labels = [w for w, _ in parts], np.array([label for _, label in parts])
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(words), BATCH)
            now, grads = self.gradients(pack([words[i] for i in pick]), labels[pick])
            loss = now if step == 1 else 0.95 * loss + 0.05 * now
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return loss

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sums over its positions: log probabilities, probabilities, 1."""
        classes = len(self.p["ob"])
        out = np.zeros((len(words), 2 * classes + 1))
        parts = [(i, w[k:k + WINDOW]) for i, w in enumerate(words) for k in range(0, len(w), WINDOW)]
        parts.sort(key=lambda x: len(x[1]))
        for at in range(0, len(parts), 4096):
            some = parts[at:at + 4096]
            codes = pack([w for _, w in some])
            probs, _ = self.probabilities(codes)
            live = (codes != _PAD)[..., None]
            sums = np.concatenate([(np.log(probs + 1e-6) * live).sum(0), (probs * live).sum(0), live.sum(0)], 1)
            np.add.at(out, [i for i, _ in some], sums)
        return out


def pack(words: list[bytes]) -> np.ndarray:
    """Byte codes (time, word), padded at the end."""
    words = [w[:WINDOW] for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), max(1, int(sizes.max(initial=1)))), _PAD, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return np.ascontiguousarray(out.T)


def training_sample(docs: DataFrame, allowed: Column, per_language: int) -> list[tuple[str, str]]:
    """(language, text) of about ``per_language`` documents of each language."""
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    rows = known.where(draw < share[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text")).collect()
    return sorted((r["lang"], r["text"]) for r in rows)


def train(sample: list[tuple[str, str]], seed: int = 0) -> tuple[list[str], ByteGru | None]:
    languages = sorted({lang for lang, _ in sample})
    words: dict[str, list[bytes]] = {lang: [] for lang in languages}
    for lang, text in sample:
        words[lang] += [w.encode("utf-8", "replace") for w in letters(text)]
    languages = [lang for lang in languages if words[lang]]
    if not languages:
        return [], None
    # The same number of words of each language: no prior.
    size = max(len(words[lang]) for lang in languages)
    rng = np.random.default_rng(seed)
    picked = [words[lang][i] for lang in languages for i in rng.integers(0, len(words[lang]), size)]
    net = ByteGru(len(languages), seed)
    net.fit(picked, np.repeat(np.arange(len(languages)), size), seed=seed)
    return languages, net


class Scorer:
    """Texts to (language, score), remembering words."""

    def __init__(self, languages: list[str], net: ByteGru | None):
        self.languages, self.net = languages, net
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, 2 * len(languages) + 1))

    def _lookup(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.sums = {}, self.sums[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            self.rows |= {w: len(self.sums) + i for i, w in enumerate(new)}
            self.sums = np.concatenate([self.sums, self.net.word_sums([w.encode("utf-8", "replace") for w in new])])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        held: list[list[str]] = []
        n = 0
        for text in [*texts, None]:
            last = len(langs) + len(held) == len(texts)
            if held and (n >= CHUNK_WORDS or last):
                a, b = self._score(held)
                langs += a
                scores += b
                held, n = [], 0
            if not last:
                held.append(letters(text) if self.net else [])
                n += len(held[-1])
        return langs, scores

    def _score(self, docs: list[list[str]]) -> tuple[list[str], list[float]]:
        k = len(self.languages)
        sizes = np.array([len(d) for d in docs])
        full = np.flatnonzero(sizes)
        langs, scores = ["und"] * len(docs), [0.0] * len(docs)
        if len(full):
            rows = self._lookup([w for d in docs for w in d])
            begins = np.r_[0, np.cumsum(sizes[full])[:-1]]
            # Sums in pieces, so that long chunks need no table of all words' sums.
            totals = np.stack([np.add.reduceat(self.sums[:, c][rows], begins) for c in range(2 * k + 1)], 1)
            best = totals[:, :k].argmax(1)
            mean = totals[np.arange(len(full)), k + best] / totals[:, -1]
            for i, at in enumerate(full):
                langs[at], scores[at] = self.languages[best[i]], float(min(1.0, max(0.0, mean[i])))
        return langs, scores


_SCORERS: dict[int, Scorer] = {}


def identify_languages(docs: DataFrame, allowed: Column, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang_pred, score of every whole text. Only rows with ``allowed`` and a
    language are learned from; the language of a row is never input of its prediction."""
    small_batches(docs.sparkSession)
    languages, net = train(training_sample(docs, allowed, per_language))
    weights = None if net is None else net.p
    name = hash((tuple(languages), b"" if weights is None else weights["o"].tobytes()))

    def run(batches):
        if name not in _SCORERS:
            _SCORERS.clear()
            model = None
            if weights is not None:
                model = ByteGru(len(languages))
                model.p = weights
            _SCORERS[name] = Scorer(languages, model)
        for batch in batches:
            langs, scores = _SCORERS[name].predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")
