"""Quality classifier by co-training.

Two logistic regressions see different views of a document: its text (hashed words and
character statistics) or its metadata (source, language, length). Both start from a
bounded sample of labelled documents. In each round both label all unlabelled documents
(their features are stored once), and what one is confident of teaches the other: Spark counts
the confident documents by label and group of sources, and ``TAUGHT`` of them, dealt evenly
over these strata, stand for all, each with the weight of its stratum. The two are then
calibrated on labelled documents kept aside (Platt scaling) and their log odds
added, less the prior counted twice. All documents are scored.

``SAMPLE`` labelled documents, those of smallest hash of their id, and in each round and view about
``TAUGHT`` pseudo-labels are all whose features pass the driver, whatever the corpus.
A document is bad if its quality is 0 or it is toxic.

Edges: null texts are empty; null or conflicting labels count as given, row by row (rows
of a null label are not learned from); without both good and bad labels nothing is
rejected and the score is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulecast.settle import discard, scratch_path

from .common import HASHES, keep_ids, small_batches
from .decontamination import _TABLE

SAMPLE = 6000
ROUNDS = 3  # of exchange
TAUGHT = 1000  # pseudo-labels a round and view that stand for all
TRUST = 0.25  # weight of all pseudo-labels of a view beside the labels, at most
CONFIDENT = 0.95
BUCKETS = 1 << 16
WORDS = 1500  # buckets a text model uses, those that differ most between classes
THRESHOLD = 0.5

_BLANKS = b" \t\n\x0b\x0c\r"
_CLASSES = [bytes(range(65, 91)), b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?", _BLANKS]
N_STATS = len(_CLASSES) + 4
META = 80


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of words and of their first five bytes, and character statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split()
    n, size = max(1, len(words)), max(1, len(raw))
    distinct = set(words)
    parts = [*distinct, *{b"^" + w[:5] for w in distinct}]
    buckets = np.unique((HASHES.of(parts) & np.uint64(BUCKETS - 1)).astype(np.int32))
    shares = [len(raw) - len(raw.translate(None, c)) for c in _CLASSES]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = [s / size for s in shares] + [np.log1p(len(words)), len(distinct) / n, len(raw) / n / 20, len(set(lines)) / max(1, len(lines))]
    return buckets, np.array(stats, np.float32)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The columns of META that are 1: hashed source, hashed language, and the length's step."""
    name = HASHES.of([f"source {source}".encode(), f"lang {lang}".encode()])
    return [int(name[0] % np.uint64(48)), 48 + int(name[1] % np.uint64(16)), 64 + min(15, int(np.log2(1 + max(0, n_chars or 0))))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights and bias, by accelerated gradient descent with a step from the data's norm."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    total = weight.sum()
    v = np.random.default_rng(0).standard_normal(x.shape[1])
    for _ in range(12):  # largest eigenvalue
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * np.linalg.norm(x.T @ (weight * (x @ v))) / total + penalty / total)
    w = look = np.zeros(x.shape[1])
    shrink = np.r_[np.full(x.shape[1] - 1, penalty / total), 0]
    for t in range(1, steps + 1):
        grad = x.T @ (weight * (_sigmoid(x @ look) - y)) / total + shrink * look
        new = look - rate * grad
        look = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


class TextModel:
    """Logistic regression on standardised statistics and the most telling buckets."""

    def __init__(self, buckets: list[np.ndarray], stats: np.ndarray, y: np.ndarray, weight: np.ndarray):
        bad, good = (np.bincount(np.concatenate([b for b, t in zip(buckets, y) if t == c] or [[]]).astype(np.int64), minlength=BUCKETS) for c in (1, 0))
        n_bad, n_good = max(1, (y == 1).sum()), max(1, (y == 0).sum())
        share = (bad + good + 0.5) / (n_bad + n_good + 1)
        z = (bad / n_bad - good / n_good) / np.sqrt(share * (1 - share).clip(1e-6) * (1 / n_bad + 1 / n_good))
        self.column = np.full(BUCKETS, -1, np.int32)
        best = np.argsort(-np.abs(z), kind="stable")[:WORDS]
        self.column[best] = np.arange(len(best))
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        self.weights = logistic(self.matrix(buckets, stats), y, weight)

    def matrix(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(buckets), WORDS + N_STATS), np.float32)
        for i, b in enumerate(buckets):
            c = self.column[b]
            out[i, c[c >= 0]] = 1
        out[:, WORDS:] = np.clip((stats - self.mean) / self.scale, -6, 6)
        return out

    def odds(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return self.matrix(buckets, stats) @ self.weights[:-1] + self.weights[-1]


class MetaModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.weights = logistic(x, y, weight)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


class CoTrained:
    """The two models with their calibration. ``teach`` gives, for the models of a round, what
    each view learns from the other: views, labels and weights by its name."""

    def __init__(self, views: dict, y: np.ndarray, teach=None, rounds: int = ROUNDS):
        aside = np.arange(len(y)) % 4 == 0
        fit, held = np.flatnonzero(~aside), np.flatnonzero(aside)
        lessons: dict = {}
        for turn in range(rounds + 1):
            self.text = TextModel(*self._joined(views, fit, y, lessons.get("text"), ("buckets", "stats")))
            self.meta = MetaModel(*self._joined(views, fit, y, lessons.get("meta"), ("meta",)))
            if turn < rounds and teach:
                lessons = teach(self)
        odds = self._odds(views, held)
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.platt = {k: logistic(o[:, None], y[held], np.ones(len(held)), penalty=1e-3, steps=400) for k, o in odds.items()}

    @staticmethod
    def _joined(views, fit, y, lesson, parts):
        chosen = [[views[k][i] for i in fit] for k in parts]
        label, weight = y[fit], np.ones(len(fit))
        if lesson:
            learned, its_label, its_weight = lesson
            chosen = [[*c, *learned[k]] for c, k in zip(chosen, parts)]
            label = np.r_[label, its_label]
            weight = np.r_[weight, its_weight * min(1, TRUST * len(fit) / its_weight.sum())]
        return [c if k == "buckets" else np.array(c) for c, k in zip(chosen, parts)] + [label, weight]

    def _odds(self, views: dict, rows: np.ndarray) -> dict[str, np.ndarray]:
        return {"text": self.text.odds([views["buckets"][i] for i in rows], views["stats"][rows]), "meta": self.meta.odds(views["meta"][rows])}

    def bad_probability(self, views: dict) -> np.ndarray:
        odds = self._odds(views, np.arange(len(views["meta"])))
        total = sum(self.platt[k][0] * o + self.platt[k][1] for k, o in odds.items()) - self.prior
        return _sigmoid(total)


def _dense(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META), np.float32)
    np.put_along_axis(out, places, 1, 1)
    return out


def views_of(texts, sources, langs, sizes) -> dict:
    seen = [text_view(t) for t in texts]
    return {"buckets": [b for b, _ in seen], "stats": np.array([s for _, s in seen], np.float32).reshape(-1, N_STATS),
            "meta": _dense(np.array([meta_view(*m) for m in zip(sources, langs, sizes)], np.int64).reshape(-1, 3))}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS bigint) doc_id", "cast(text AS string) text", "cast(source AS string) source",
                           "cast(lang AS string) lang", "cast(n_chars AS bigint) n_chars")


_FEATURES = "row bigint, y double, buckets array<int>, stats array<float>, places array<int>"


def _features(rows: DataFrame) -> DataFrame:
    """A hash of doc_id and text, y, and the two views of every row."""

    def lists(arrays: list, kind) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0)]), kind, safe=False))

    def run(batches):
        for batch in batches:
            text, source, lang, size = (c.to_pylist() for c in batch.columns[2:6])
            seen = [text_view(t) for t in text]
            places = [meta_view(*m) for m in zip(source, lang, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists([b for b, _ in seen], pa.int32()), lists([x for _, x in seen], pa.float32()),
                 lists(places, pa.int32())], names=["row", "y", "buckets", "stats", "places"])

    return rows.select(F.xxhash64("doc_id", "text").alias("row"), F.col("y").cast("double").alias("y"), "text", "source", "lang", "n_chars").mapInArrow(run, _FEATURES)


def _views(table: pa.Table | pa.RecordBatch) -> dict:
    """The views in rows of _features, as numpy views of Arrow's buffers."""
    columns = {}
    for name in ("buckets", "stats", "places"):
        column = table.column(name)
        columns[name] = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, values = columns["buckets"].offsets.to_numpy(), columns["buckets"].values.to_numpy()
    return {"buckets": [values[a:b] for a, b in zip(ends[:-1], ends[1:])],
            "stats": columns["stats"].flatten().to_numpy().reshape(-1, N_STATS),
            "meta": _dense(columns["places"].flatten().to_numpy().astype(np.int64).reshape(-1, 3))}


_CONFIDENT = "pupil string, row bigint, label double, stratum int"


def _confident(pool: DataFrame, model: CoTrained) -> DataFrame:
    """pupil, row, label and stratum (of sources) of what one view is sure of."""
    shared = pool.sparkSession.sparkContext.broadcast((model.text, model.meta))
    least = np.log(CONFIDENT / (1 - CONFIDENT))

    def run(batches):
        text, meta = shared.value
        for batch in batches:
            v = _views(batch)
            source = v["meta"][:, :48].argmax(1)
            for pupil, odds in (("meta", text.odds(v["buckets"], v["stats"])), ("text", meta.odds(v["meta"]))):
                sure = np.flatnonzero(np.abs(odds) >= least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pupil] * len(sure)).cast(pa.string()), batch.column(0).take(pa.array(sure)),
                     pa.array((odds[sure] > 0).astype(float)), pa.array(source[sure].astype(np.int32))], names=["pupil", "row", "label", "stratum"])

    return pool.mapInArrow(run, _CONFIDENT)


def _teacher(pool: DataFrame, scratch: str):
    """For a model, the lessons of all rows of ``pool``: TAUGHT of each view's, by strata. (There are
    at most 2 x 2 x 48 strata, and about TAUGHT rows a view.)"""
    spark = pool.sparkSession

    def teach(model: CoTrained) -> dict:
        path = scratch_path(spark, f"{scratch}-confident")
        _confident(pool, model).write.parquet(path)
        sure = spark.read.schema(_CONFIDENT).parquet(path)
        sizes = sure.groupBy("pupil", "label", "stratum").count()
        quota = sizes.groupBy("pupil").agg(F.expr(f"{TAUGHT} / count(*)").alias("quota"))
        rates = sizes.join(F.broadcast(quota), "pupil").selectExpr("pupil", "label", "stratum", "least(1D, quota / count) AS rate")
        # a share of the hash's range; the rows drawn stand for their whole stratum
        chosen = (sure.join(F.broadcast(rates), ["pupil", "label", "stratum"]).where("pmod(row, 1000003) < rate * 1000003")
                  .select("pupil", "row", "label", (1 / F.col("rate")).alias("weight")).distinct())
        table = pool.join(F.broadcast(chosen), "row").orderBy("row").toArrow()
        discard(spark, path)
        lessons = {}
        for pupil in ("text", "meta"):
            part = table.filter(pa.compute.equal(table.column("pupil"), pupil))
            if part.num_rows:
                lessons[pupil] = (_views(part), part.column("label").to_numpy(), part.column("weight").to_numpy())
        return lessons

    return teach


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    spark, docs = docs.sparkSession, _columns(docs)
    bad = labels.selectExpr("cast(doc_id AS bigint) doc_id", "cast(quality = 0 OR toxic = 1 AS double) y").where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = bad.orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "y").limit(SAMPLE)
    table = _features(docs.join(F.broadcast(known), "doc_id")).toArrow().sort_by([("row", "ascending"), ("y", "ascending")])
    views, y = _views(table), table.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    if not rounds:
        return CoTrained(views, y)
    path = scratch_path(spark, "unlabelled")
    pool = keep_ids(docs, bad.select("doc_id").distinct(), "left_anti").withColumn("y", F.lit(None))
    _features(pool).write.parquet(path)
    try:
        return CoTrained(views, y, _teacher(spark.read.schema(_FEATURES).parquet(path), "quality"), rounds)
    finally:
        discard(spark, path)


def _scorer(docs: DataFrame, labels: DataFrame, rounds: int):
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rounds))

    def score(columns: list) -> list:
        if model.value is None:
            return [None] * len(columns[0])
        out: list[float] = []
        for at in range(0, len(columns[0]), 500):
            out += model.value.bad_probability(views_of(*(c[at:at + 500] for c in columns))).tolist()
        return out

    return score


def score_documents(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, bad_score (0 to 1) and kept for every row of ``docs`` (doc_id, text, source,
    lang, n_chars); ``labels`` has doc_id, quality and toxic."""
    score = _scorer(docs, labels, rounds)

    def run(batches):
        for batch in batches:
            p = score([c.to_pylist() for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(p, pa.float64()), pa.array([x is None or x < THRESHOLD for x in p], pa.bool_())],
                names=["doc_id", "bad_score", "kept"])

    return _columns(docs).mapInArrow(run, "doc_id bigint, bad_score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (all columns) without the rejected documents."""
    score = _scorer(docs, labels, rounds)
    names = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches):
        for batch in batches:
            p = score([batch.column(i).to_pylist() for i in names])
            yield batch.filter(pa.array([x is None or x < THRESHOLD for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
