"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, pairs of neighbouring
words, pairs with one word between, and stems: the first letters of a longer
word, with how often a text has them (once, twice, four times). Stems tell what
inflected or compounded words have in common, of which each is too rare to be
learned. Rates are kept per coordinate, and the L1 term leaves most weights at
zero, so the fitted model is a short list of (feature, weight) that every task
gets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import materialise, release
from weirmark.llm.samples import labelled_sample, remainder

#: Labelled documents of each class that the weights are fitted on, at most.
PER_CLASS = 4000
BITS = 20
#: Letters of a stem, and the counts that are features of their own.
STEM, STEM_COUNTS = 4, (1, 2, 4)
#: Chosen, with the stems, by five-fold cross-validation inside the rows that may be learned from: without stems a recall of 0.807 at 0.0057 false positives and a log-loss of 0.0907, with them 0.946, 0.0025 and 0.0428.
ALPHA, BETA, L2, EPOCHS = 1.0, 1.0, 0.1, 6
#: L1 is LEAST_L1 plus one for each of this many examples: a feature must move more than chance does.
LEAST_L1, L1_EXAMPLES = 3.0, 350
#: Words whose hashes a task remembers.
MEMORY = 1 << 16
#: Rows that are filtered at a time.
SLICE = 500
#: Margin of a model that has learned nothing.
NOTHING = -1e-6
#: Features, their weights, and the bias.
Model = tuple[np.ndarray, np.ndarray, float]

_WORD = re.compile(r"\w+")
_PAIR, _SKIP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


class Hasher:
    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint32(32 - bits), {}

    def features(self, text: str) -> np.ndarray:
        """Distinct features of a text, in order."""
        known, hashes, stems = self.known, [], []
        if len(known) > MEMORY:
            known.clear()
        for w in _WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode()), zlib.crc32(w[:STEM].encode()) if len(w) > STEM else None
            hashes.append(h[0])
            if h[1] is not None:
                stems.append(h[1])
        h = np.array(hashes, np.uint32)
        pairs = (h[:-1] * _PAIR) ^ (h[1:] + _SKIP)
        skips = (h[:-2] * _SKIP) ^ (h[2:] + _PAIR)
        stem, count = np.unique(np.array(stems, np.uint32), return_counts=True)
        often = [(stem[count >= c] + np.uint32(c)) * np.uint32(0x165667B1) for c in STEM_COUNTS]
        found = np.concatenate((h * np.uint32(0x2545F491), pairs * np.uint32(0xC2B2AE3D), skips * np.uint32(0x27D4EB2F), *often))
        return np.unique((found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> self.shift).astype(np.int32)


class Ftrl:
    """FTRL-proximal over sparse binary features, one example after another."""

    def __init__(self, classes: tuple[int, int], bits: int = BITS):
        """``classes``: examples of label 0 and 1; each class weighs the same."""
        self.z, self.n, self.bias, self.bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
        self.weight = [sum(classes) / 2 / max(c, 1) for c in classes]
        self.l1 = LEAST_L1 + sum(classes) / L1_EXAMPLES

    def current(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.current(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30)))
        g = self.weight[y] * (p - y)
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g
        self.bias_n += g * g
        self.bias -= ALPHA * g / (BETA + np.sqrt(self.bias_n))

    def model(self) -> Model:
        weights = self.current(np.arange(len(self.z)))
        kept = np.flatnonzero(weights)
        # Nothing learned, nothing toxic: without any weight a text is just under 0.5.
        return kept.astype(np.int32), weights[kept].astype(np.float32), float(self.bias) if len(kept) else NOTHING


class Scorer:
    """Scores of texts; 0.5 or more is toxic. Every use of a model goes through this."""

    def __init__(self, model: Model):
        kept, weights, self.bias = model
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[kept] = weights
        self.hasher = Hasher()

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        margin = np.array([self.dense[self.hasher.features(t or "")].sum(dtype=np.float64) + self.bias for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        found = [hasher.features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "x"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(t.as_py() for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Weights fitted on a sample of at most ``per_class`` documents of each label.

    Features are made once, by Spark, and stay on its side: each epoch reads
    them in an order of its own, that ids fix, a partition at a time. Of texts
    that share an id the one with the least features counts.
    """
    sample = labelled_sample(docs, labels, label_col, held_out, per_class, id_col, text_col)
    examples = materialise(sample.select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, x binary").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "features")
    counts = {r["y"]: r["count"] for r in examples.groupBy("y").count().collect()}
    ftrl = Ftrl((counts.get(0, 0), counts.get(1, 0)))
    for epoch in range(EPOCHS if counts else 0):
        for r in examples.orderBy(F.xxhash64("doc_id", F.lit(epoch)), "doc_id").select("x", "y").toLocalIterator(prefetchPartitions=True):
            ftrl.learn(np.frombuffer(r["x"], np.int32), r["y"])
    release(examples)
    return ftrl.model()


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``held_out`` is (parts, part): labels of rows whose crc32(id as text) has
    remainder ``part`` are never read. ``score`` is higher the likelier label
    1; without a label or a sign of toxicity in them it is just under 0.5 for
    all, so nothing is predicted toxic. Null text counts as empty; a null id is
    held out; repeated rows are rows like others; an empty table gives an empty
    result; other columns are ignored. Texts are taken whole, however long.
    """
    parts, part = held_out
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, held_out, label_col, id_col, text_col, per_class))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", parts) == part, F.lit(True)).alias("held_out"), "score", "predicted")


def _keep(shared, text_col: str):
    """Passes on the rows of a document table whose text is not toxic, all columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                batch = whole.slice(s, SLICE)
                yield batch.filter(pa.array(scorer.scores(t.as_py() for t in batch.column(text_col)) < 0.5, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that ``classify_toxicity`` does not predict toxic, all columns as they came, in one pass over them.

    Null texts count as empty; rows that repeat an id are judged by their own
    texts; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, held_out, label_col, id_col, text_col, per_class))
    return docs.mapInArrow(_keep(shared, text_col), docs.schema)
