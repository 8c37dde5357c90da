"""Quality classification by co-training (operator 6).

Two views of a document: its text (shape, repetition, vocabulary and hashed words,
measured on the whole text) and its page metadata (language and source). A logistic
classifier per view starts from labelled rows. In each round each view hands all
unlabelled rows that it is surest of, in the labelled classes' proportion, to the
other view as training rows, and both are fitted again; a view never learns from its
own guesses. Both views are then calibrated (Platt scaling) on labelled rows kept
back from training, and their calibrated log-odds are combined, weighted by how well
each view does there, into the score of every document.

A view is sure of a row whose odds differ from the base rate's by a factor of
``SURE`` or more. In round r of ``rounds`` it hands over the surest ones, up to r x
``growth`` of all unlabelled rows (at least ``STEP`` of log-odds deep, so that ties
stay together); where it is sure of one kind only it hands over none. Handed rows
weigh, together, r / ``rounds`` x ``trust`` of the labelled rows, however many there are.

All unlabelled rows take part, a million as a hundred: features are written once, and
each pass over them sums a histogram, counts by metadata or a Newton step's sums in
the tasks. The driver gets those sums and at most ``max_labelled`` labelled rows (the
lowest by a hash of doc_id). Sources beyond the ``max_sources`` and languages beyond
the ``max_langs`` most frequent ones, counted over all documents, share an indicator.

Cases: null and empty texts have the features of an empty text; null metadata is
a value of its own; a null doc_id is scored and counts as unlabelled; of rows that
share a labelled doc_id one (the least by its features) is learned from; repeated rows
are scored alike; with labels of one kind (or none) every score is that kind's share
(0.5 without labels); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import new_path, release, written
from .batches import small_batches
from .toxicity import held_out, logistic

MAX_LABELLED = 20_000
MAX_LANGS = 100
MAX_SOURCES = 200
ROUNDS = 4
#: Share of the unlabelled rows that a view hands over in a round, at most.
GROWTH = 0.02
#: Weight of handed rows in the last round, labelled rows being 1.
TRUST = 0.5
#: How far a view's odds must be from the base rate's to count as sure.
SURE = 4.0
THRESHOLD = 0.5

#: Log-odds lie within +-30, in a histogram of this step.
STEP = 0.05
_BINS = round(60 / STEP) + 1
#: Newton steps on the text view in a round, from the weights of the round before.
_NEWTON = 2
_RIDGE = 3e-3

_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
N_SHAPE = 14
#: Words fall into this many classes by a hash; a text has its share of each.
N_WORDS = 64
N_TEXT = N_SHAPE + N_WORDS


def text_view(text: str | None) -> list[float]:
    """Shape and words of a whole text, as numbers of moderate size."""
    text = text or ""
    n, words, lines = len(text), text.split(), text.split("\n")
    count = len(words)
    if not count:
        return [0.0] * (N_SHAPE - 1) + [1.0] + [0.0] * N_WORDS
    tally = Counter(words)
    distinct = len(tally)
    repeated = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    odd = len(_ODD.findall(text))
    digits = sum(map(text.count, "0123456789"))
    ends = text.count(".") + text.count("!") + text.count("?")
    length = sum(map(len, words)) / count
    entropy = math.log(count) - sum(c * math.log(c) for c in tally.values()) / count
    shares = [0.0] * N_WORDS
    for word, c in tally.items():
        shares[zlib.crc32(word.encode("utf-8", "surrogatepass")) % N_WORDS] += c / count
    return [
        math.log(count),
        length / 10,
        distinct / count,
        math.log(distinct) / math.log(count + 1),
        entropy / math.log(count + 1),
        repeated / count,
        math.log1p(100 * odd / n),
        math.log1p(100 * digits / n),
        ends / count,
        text.count("|") / count,
        1 - len(set(lines)) / len(lines),
        math.log(n / len(lines)) / 10,
        tally.most_common(1)[0][1] / count,
        0.0,
        *(math.sqrt(s) for s in shares),
    ]


@dataclass(frozen=True)
class Metadata:
    """Frequent languages and sources; the page view of a row is its cell, a pair of them."""

    langs: tuple[str, ...]
    sources: tuple[str, ...]

    @property
    def cells(self) -> int:
        return (len(self.langs) + 2) * (len(self.sources) + 2)

    def cell(self, langs: list[str | None], sources: list[str | None]) -> np.ndarray:
        """A number for each row's pair; null and rare values have numbers of their own."""
        places = [{None: 0} | {x: k + 2 for k, x in enumerate(names)} for names in (self.langs, self.sources)]
        a, b = ([place.get(x, 1) for x in column] for place, column in zip(places, (langs, sources), strict=True))
        return np.array(a, np.int64) * (len(self.sources) + 2) + np.array(b, np.int64)

    def view(self, cells: np.ndarray) -> np.ndarray:
        """Indicators of the language and the source."""
        a, b = np.divmod(cells, len(self.sources) + 2)
        return np.column_stack([a[:, None] == np.arange(len(self.langs) + 2), b[:, None] == np.arange(len(self.sources) + 2)]).astype(float)


@dataclass(frozen=True)
class View:
    """A standardised logistic classifier with Platt calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    platt: tuple[float, float] = (0.0, 1.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x) @ self.weights, -30, 30)

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        a, b = logistic(self.raw(x)[:, None], y, ridge=1e-2)
        return replace(self, platt=(float(a), max(0.0, float(b))))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] + self.platt[1] * self.raw(x)


@dataclass(frozen=True)
class Model:
    metadata: Metadata
    views: tuple[View, ...]
    mix: tuple[float, ...]
    base: float

    def score(self, text: np.ndarray, cells: np.ndarray) -> np.ndarray:
        if not self.views:
            return np.full(len(text), self.base)
        odds = self.mix[0] + self.mix[1] * self.views[0].odds(text) + self.mix[2] * self.views[1].odds(self.metadata.view(cells))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted log-loss at ``w``, in one array."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    hessian = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x
    return np.concatenate([x.T @ (weight * (p - y)), hessian.reshape(-1)])


def newton_step(sums: np.ndarray, total: float, w: np.ndarray) -> np.ndarray:
    """Weights after a step with the sums of rows that weigh ``total``."""
    d = len(w)
    penalty = np.full(d, _RIDGE)
    penalty[0] = 1e-9
    return w - np.linalg.solve(sums[d:].reshape(d, d) / total + np.diag(penalty), sums[:d] / total + penalty * w)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, steps: int = 40) -> np.ndarray:
    for _ in range(steps):
        before, w = w, newton_step(newton_sums(x, y, weight, w), weight.sum(), w)
        if np.abs(w - before).max() < 1e-8:
            break
    return w


def bins(odds: np.ndarray) -> np.ndarray:
    return np.rint((odds + 30) / STEP).astype(np.int64)


def cuts(histogram: np.ndarray, base: float, rows: float) -> tuple[int, int] | None:
    """The highest bin of surely bad rows and the lowest of surely good ones; none without rows of both kinds.

    About ``rows`` rows lie beyond the cuts, in the proportion of ``base``, ends of whole bins.
    """
    centre, far = math.log(base / (1 - base)), math.log(SURE)
    low_end, high_end = math.floor((centre - far + 30) / STEP), math.ceil((centre + far + 30) / STEP)
    low, high = np.flatnonzero(histogram[: max(0, low_end + 1)]), high_end + np.flatnonzero(histogram[high_end:])
    if not len(low) or not len(high):
        return None
    in_low, in_high = np.cumsum(histogram[low]), np.cumsum(histogram[high][::-1])
    a = max(0, np.searchsorted(in_low, rows * (1 - base), "right") - 1)
    b = max(0, np.searchsorted(in_high, rows * base, "right") - 1)
    return int(low[a]), int(high[::-1][b])


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum, over all (text, cell) batches of rows, of arrays of ``size`` numbers that ``partial`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += partial(_matrix(batch.column(0)), batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    sums = rows.select("x", "cell").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    return out


def _matrix(x: pa.Array) -> np.ndarray:
    """Text views as rows of a matrix."""
    return np.asarray(x.flatten(), dtype=float).reshape(len(x), N_TEXT)


def co_train(
    pool: DataFrame, metadata: Metadata, text: View, page: View, x: np.ndarray, cells: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, growth: float = GROWTH, trust: float = TRUST
) -> tuple[View, View]:
    """The two views after exchanging their surest guesses on the pool; ``x``, ``cells`` and ``y`` are the labelled rows."""
    base, n = float(y.mean()), len(y)
    xs, ps, ones = text.scaled(x), page.scaled(metadata.view(cells)), np.ones(n)
    text = replace(text, weights=fitted(xs, y, ones, text.weights))
    page = replace(page, weights=fitted(ps, y, ones, page.weights))
    per_cell = _summed(pool, lambda _, c: np.bincount(c, minlength=metadata.cells), metadata.cells)
    every = np.flatnonzero(per_cell)
    in_cells, size = per_cell[every], per_cell.sum()
    every_page = page.scaled(metadata.view(every))

    def shares(counts: np.ndarray, weight: float) -> np.ndarray:
        """What a handed bad and a handed good row weigh."""
        return weight * np.array([1 - base, base]) / np.maximum(counts, 1)

    for r in range(1, rounds + 1 if size else 1):
        weight = trust * n * r / rounds
        # guesses of the page view are guesses about cells
        in_bin = bins(page.raw(metadata.view(every)))
        sure = cuts(np.bincount(in_bin, in_cells, _BINS), base, r * growth * size)
        guess = np.full(metadata.cells, -1)
        if sure:
            guess[every[in_bin <= sure[0]]], guess[every[in_bin >= sure[1]]] = 0, 1
        guessed = guess[every]
        each = shares(np.array([in_cells[guessed == k].sum() for k in (0, 1)]), weight)
        # guesses of the text view, counted by cell
        teacher = text
        histogram = _summed(pool, lambda t, _: np.bincount(bins(teacher.raw(t)), minlength=_BINS), _BINS)  # noqa: B023
        handed = cuts(histogram, base, r * growth * size)
        if handed:

            def by_cell(t: np.ndarray, c: np.ndarray) -> np.ndarray:
                at = bins(teacher.raw(t))  # noqa: B023
                return np.concatenate([np.bincount(c[some], minlength=metadata.cells) for some in (at <= handed[0], at >= handed[1])])  # noqa: B023

            counts = _summed(pool, by_cell, 2 * metadata.cells).reshape(2, -1)[:, every]
            weights = counts * shares(counts.sum(axis=1), weight)[:, None]
            page_weights = fitted(np.vstack([ps, every_page, every_page]), np.concatenate([y, np.zeros(len(every)), np.ones(len(every))]), np.concatenate([ones, *weights]), page.weights)
        else:
            page_weights = fitted(ps, y, ones, page.weights)
        # both views learn from what the other one was before this round
        if sure:
            for _ in range(_NEWTON):
                now = text

                def step(t: np.ndarray, c: np.ndarray) -> np.ndarray:
                    some = guess[c] >= 0  # noqa: B023
                    label = guess[c[some]]  # noqa: B023
                    return newton_sums(now.scaled(t[some]), label, each[label], now.weights)  # noqa: B023

                d = len(now.weights)
                sums = _summed(pool, step, d * (d + 1)) + newton_sums(xs, y, ones, now.weights)
                text = replace(now, weights=newton_step(sums, n + weight, now.weights))
        else:
            text = replace(text, weights=fitted(xs, y, ones, text.weights))
        page = replace(page, weights=page_weights)
    return text, page


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))))


def _features(rows: DataFrame, metadata: Metadata) -> DataFrame:
    """(doc_id, x array<float>, cell): both views of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([text_view(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float32()))
            cells = metadata.cell(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), x, pa.array(cells, pa.int64())], ["doc_id", "x", "cell"])

    return rows.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, x array<float>, cell long")


def _metadata(rows: DataFrame, max_langs: int, max_sources: int) -> Metadata:
    # counted over all rows; that many names reach the driver
    frequent = lambda c, n: tuple(r[c] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(n).collect())
    return Metadata(frequent("lang", max_langs), frequent("source", max_sources))


def _fit(stored: DataFrame, metadata: Metadata, labels: DataFrame, target: str, max_labelled: int) -> Model:
    """The model of stored feature rows (doc_id, x, cell, known)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)
    )
    taught = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of 12 bytes: bounded by the parameter
    chosen = stored.where("known").join(F.broadcast(taught), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "cell")).alias("f"), F.first("y").alias("y"))
    data = chosen.select("doc_id", "y", "f.x", "f.cell").toArrow().sort_by("doc_id")
    y, cells = data.column("y").to_numpy().astype(float), data.column("cell").to_numpy()
    x = _matrix(data.column("x").combine_chunks())
    if len(set(y)) < 2:
        return Model(metadata, (), (), float(y.mean()) if len(y) else 0.5)
    kept_back = np.arange(1, len(y) + 1) % 4 == 0
    train = ~kept_back
    if len(set(y[kept_back])) < 2 or len(set(y[train])) < 2:
        kept_back = train = np.ones(len(y), bool)
    pool = stored.where(~F.col("known")).select("x", "cell")
    spread = x[train].std(axis=0)
    d = len(metadata.langs) + len(metadata.sources) + 4
    text = View(x[train].mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(N_TEXT + 1))
    page = View(np.zeros(d), np.ones(d), np.zeros(d + 1))
    views = co_train(pool, metadata, text, page, x[train], cells[train], y[train])
    back = (x[kept_back], metadata.view(cells[kept_back]))
    views = tuple(v.calibrated(part, y[kept_back]) for v, part in zip(views, back, strict=True))
    mix = logistic(np.column_stack([v.odds(part) for v, part in zip(views, back, strict=True)]), y[kept_back], ridge=1e-2)
    return Model(metadata, views, tuple(float(m) for m in mix), float(y.mean()))


def _stored(docs: DataFrame, labels: DataFrame, target: str, max_langs: int, max_sources: int, path: str) -> tuple[DataFrame, Metadata]:
    """Features of all rows in shared storage, and whether each row's doc_id has a label."""
    small_batches(docs.sparkSession)
    rows = _plain(docs)
    metadata = _metadata(rows, max_langs, max_sources)
    ids = labels.where(F.col(target).cast("int").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    marked = _features(rows, metadata).join(ids.withColumn("known", F.lit(True)), "doc_id", "left")
    return written(marked.select("doc_id", "x", "cell", F.coalesce("known", F.lit(False)).alias("known")), "quality", path), metadata


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labelled: int = MAX_LABELLED, max_langs: int = MAX_LANGS, max_sources: int = MAX_SOURCES) -> Model:
    spark = docs.sparkSession
    path = new_path(spark, "quality")
    try:
        stored, metadata = _stored(docs, labels, target, max_langs, max_sources, path)
        return _fit(stored, metadata, labels, target, max_labelled)
    finally:
        release(spark, path)


def _scored(features: DataFrame, model: Model, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrix(batch.column(1)), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(p >= threshold)],
                ["doc_id", "score", "predicted", "keep"],
            )

    scored = features.select("doc_id", "x", "cell").mapInArrow(run, "doc_id long, score double, predicted int, keep boolean")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "keep")


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, keep) of every row."""
    small_batches(docs.sparkSession)
    return _scored(_features(_plain(docs), model.metadata), model, threshold)


def classified(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD, **limits: int) -> DataFrame:
    """What :func:`score` gives with the model learned from the same documents, whose features are made once."""
    limits = {"max_labelled": MAX_LABELLED, "max_langs": MAX_LANGS, "max_sources": MAX_SOURCES} | limits
    stored, metadata = _stored(docs, labels, target, limits["max_langs"], limits["max_sources"], new_path(docs.sparkSession, "quality"))
    return _scored(stored, _fit(stored, metadata, labels, target, limits["max_labelled"]), threshold)
