"""Toxicity by a weighted lexicon (operator 5).

Texts are lower-cased and folded (homoglyphs, then digits and signs that stand for
letters); an Aho-Corasick automaton finds every lexicon term and exception phrase in
one pass over the whole text. A term counts where it stands as a word and no
exception phrase covers it. Whether it does is asked of the text before signs became
letters, so ``idiot!`` and ``$idiot`` hold a word beside a sign, and ``id!ot`` a word
with one inside. The sum of the weights, as it is and per hundred words, goes through
a two-feature logistic calibration.

Lexicon, exceptions, weights and calibration are learned from labelled rows: at most
``max_train`` of them, the lowest by a hash of doc_id. A word is a term by its share
of toxic rows; a pair of words with a term in it is an exception if it stands in
several rows and none of them, or hardly any, is toxic. Near copies among them are
set aside (one row per minimum shingle hash), so that one text's vocabulary
cannot pass for a class's. Scoring itself is a map over all rows.

Cases: null and empty texts have no hits and the score of a text without hits;
rows without doc_id are scored as any others (null doc_id, not held out, never used to
learn); of rows that share a doc_id any may be learned from, all with that id's label;
repeated rows are scored alike; without labels of both kinds the score is 0
everywhere; unknown columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .folding import LETTERS, SHAPES

MAX_TRAIN = 20_000
THRESHOLD = 0.7
#: Rows that a phrase must stand in to be an exception, and its largest share of toxic ones.
EXCEPTION_ROWS, EXCEPTION_SHARE = 5, 0.1

#: Letters and digits, with signs that may stand for letters only between them.
_WORD = re.compile(r"\w+(?:[@$!]+\w+)*")


def shaped(text: str | None) -> str:
    """Lower case, look-alikes as Latin letters and digits: one character each."""
    return (text or "").lower().translate(SHAPES)


def fold(text: str | None) -> str:
    """``shaped``, with digits and signs as the letters that they stand for: as long, place by place."""
    return shaped(text).translate(LETTERS)


def words_of(text: str | None) -> list[str]:
    """The folded words of a text."""
    return [w.translate(LETTERS) for w in _WORD.findall(shaped(text))]


@dataclass(frozen=True)
class Lexicon:
    """Term weights, exception phrases and the calibration ``bias, total, density``."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    calibration: tuple[float, float, float] = (-math.inf, 0.0, 0.0)
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.calibration

    def __setstate__(self, state):
        for name, value in zip(("weights", "exceptions", "calibration"), state, strict=True):
            object.__setattr__(self, name, value)
        object.__setattr__(self, "_automaton", [])

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(folded := fold(phrase), (len(folded), 0.0))
            made.make_automaton()
            self._automaton.append(made)
        return self._automaton[0]

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Log of the weighted hits, their density per hundred words, and their number."""
        if not self.weights or not text:
            return 0.0, 0.0, 0
        plain = shaped(text)
        found, excused = [], []
        size = len(plain)
        for end, (length, weight) in self.automaton().iter(plain.translate(LETTERS)):
            start = end - length + 1
            if (start and plain[start - 1].isalnum()) or (end + 1 < size and plain[end + 1].isalnum()):
                continue
            (found if weight else excused).append((start, end, weight))
        if not found:
            return 0.0, 0.0, 0
        kept = [w for s, e, w in found if not any(a <= s and e <= b for a, b, _ in excused)]
        total = sum(kept)
        words = max(1, len(text.split()))
        return math.log1p(total), 100.0 * total / max(words, 20), len(kept)

    def probability(self, total: float, density: float) -> float:
        bias, of_total, of_density = self.calibration
        x = bias + of_total * total + of_density * math.log1p(density)
        return 0.0 if x < -700 else 1.0 / (1.0 + math.exp(-x))


def held_out(doc_id: str = "doc_id"):
    """True for the third of the rows that no label is learned from; false without doc_id."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows that aren't held out: doc_id, text, y."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # at most `limit` rows of 12 bytes: bounded by the parameter, so it may be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )


def _distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per minimum hash of three-word shingles: the copies of a text mostly fall together."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                grams = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
                least.append(min(crc32(g.encode()) for g in grams))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])

    return (
        rows.select("doc_id", "text", "y")
        .mapInArrow(sketch, "doc_id long, text string, y int, least long")
        .groupBy("least")
        .agg(F.min(F.struct("doc_id", "text", "y")).alias("row"))
        .select("row.*")
    )


def _terms(rows: DataFrame) -> DataFrame:
    """(term, y) for each distinct folded word of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted(set(words_of(text)))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y] * len(words), pa.int32())], ["term", "y"])

    return rows.select("text", "y").mapInArrow(run, "term string, y int")


def _phrases(rows: DataFrame, terms: set[str]) -> DataFrame:
    """(phrase, y) for each distinct pair of neighbouring words, one blank apart, of which one is a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if (a in terms) != (b in terms)})
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array([y] * len(pairs), pa.int32())], ["phrase", "y"])

    return rows.select("text", "y").mapInArrow(run, "phrase string, y int")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + penalty @ w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_train: int = MAX_TRAIN) -> Lexicon:
    """A lexicon from the labelled rows that aren't held out.

    A term is taken if the lower end of the interval of its share of toxic rows
    (two standard deviations) lies far above the base rate, and it occurs in at
    least a hundredth of the toxic rows, so their number is bounded by a hundred
    times the words of a toxic row. What reaches the driver are terms, exceptions
    and three numbers a training row.
    """
    small_batches(docs.sparkSession)
    rows = _distinct_texts(_training_rows(docs, labels, target, max_train)).persist()
    try:
        n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
        toxic = toxic or 0
        if not toxic or toxic == n:
            return Lexicon({})
        base = toxic / n
        share = (F.sum("y") + base) / (F.count("*") + 1)
        counted = _terms(rows).groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("tf"), share.alias("share"))
        sure = F.col("share") - 2 * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("df") + 1 / (4 * F.col("df") * F.col("df")))
        found = (
            counted.where((F.col("tf") >= F.lit(max(3, math.ceil(0.01 * toxic)))))
            .withColumn("sure", sure)
            .where(F.col("sure") >= min(0.95, base + 0.25 * (1 - base)))
            .orderBy("term")
            .collect()
        )
        odds = math.log(base / (1 - base))
        weights = {r["term"]: round(math.log((r["share"] + 1e-3) / (1 - r["share"] + 1e-3)) - odds, 4) for r in found}
        if not weights:
            return Lexicon({}, calibration=(odds, 0.0, 0.0))
        harmless = (
            _phrases(rows, set(weights))
            .groupBy("phrase")
            .agg(F.count("*").alias("df"), F.sum("y").alias("tf"))
            .where((F.col("df") >= EXCEPTION_ROWS) & (F.col("tf") <= EXCEPTION_SHARE * F.col("df")))
            .orderBy("phrase")
            .collect()
        )
        exceptions = tuple(r["phrase"] for r in harmless)
        lexicon = Lexicon(weights, exceptions)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [lexicon.features(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[0] for e in each], pa.float64()), pa.array([e[1] for e in each], pa.float64()), batch.column(1)],
                    ["total", "density", "y"],
                )

        seen = rows.select("text", "y").mapInArrow(measure, "total double, density double, y int").collect()
        data = np.array(seen, dtype=float)
        fitted = logistic(np.column_stack([data[:, 0], np.log1p(data[:, 1])]), data[:, 2])
        return Lexicon(weights, exceptions, tuple(float(v) for v in fitted))
    finally:
        rows.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, hits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                total, density, n = lexicon.features(text)
                scores.append(lexicon.probability(total, density))
                hits.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(hits, pa.int32()),
                ],
                ["doc_id", "score", "predicted", "hits"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int, hits int"
    )


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are."""
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                total, density, _ = lexicon.features(text)
                clean.append(lexicon.probability(total, density) < threshold)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
