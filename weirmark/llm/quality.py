"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are binned by quantiles of the labelled sample;
trees of one depth are grown level by level from histograms of gradients. The
fitted trees lie in three flat arrays (feature, threshold, leaf), and a batch
of documents goes down all of them by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.samples import labelled_sample, remainder

#: Labelled documents of each class that the trees are fitted on, at most.
PER_CLASS = 5000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 2.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "word_spread", "longest_word", "letters", "upper", "digits", "spaces", "newlines",
    "punctuation", "full_stops", "commas", "exclamations", "bars", "other_signs", "beyond_ascii", "distinct_words", "top_word", "same_as_before",
    "distinct_pairs", "short_words", "lines", "distinct_lines", "mean_line", "spread_of_bytes",
)

_BYTES = np.arange(256)
_IS = {
    "letters": ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "spaces": _BYTES == 32,
    "newlines": _BYTES == 10,
    "punctuation": np.isin(_BYTES, list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")),
    "full_stops": _BYTES == 46,
    "commas": _BYTES == 44,
    "exclamations": _BYTES == 33,
    "bars": _BYTES == 124,
    "other_signs": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~")),
    "beyond_ascii": _BYTES >= 128,
}
_SUMS = np.array(list(_IS.values()), np.float64).T


def statistics(text: str) -> list[float]:
    """The FEATURES of a text; all finite, also for an empty one."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    shares = counts[counts > 0] / n
    kinds = counts @ _SUMS / n
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), *kinds.tolist(),
        len(distinct) / m, max(distinct.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        len(pairs) / max(1, len(words) - 1), float((lengths <= 3).mean()), float(np.log1p(len(lines))), len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))), float(-(shares * np.log2(shares)).sum()),
    ]


class Trees:
    """Boosted trees of one depth: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    n, f = x.shape
    if not n or weight.sum() == 0:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    start = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge k: code <= k
    cell = code + np.arange(f) * bins
    inner = 2**depth - 1
    all_feature, all_threshold, all_leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    margin = np.full(n, start)
    rows = np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + cell).ravel()
            shape = (width, f, bins)
            gs = np.bincount(at, np.repeat(g, f), width * f * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, f), width * f * bins).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
            gain[(hs < LEAST_WEIGHT) | (ha - hs < LEAST_WEIGHT)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            j, b = best // bins, best % bins
            for k in np.flatnonzero(good).tolist():
                all_feature[t, first + k], all_threshold[t, first + k] = j[k], edges[j[k]][b[k]]
            node = 2 * node + 1 + (x[rows, all_feature[t, node]] > all_threshold[t, node])
        leaf = node - inner
        all_leaf[t] = -RATE * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + L2)
        margin += all_leaf[t, leaf]
    return Trees(all_feature, all_threshold, all_leaf, start)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.probability(x))], names=["doc_id", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Trees:
    """Trees fitted on a sample of at most ``per_class`` documents of each label; both classes weigh the same. Of texts that share an id the one with the least statistics counts."""
    sample = labelled_sample(docs, labels, label_col, held_out, per_class, id_col, text_col)
    rows = sample.select("doc_id", "y", "text").mapInArrow(_statistics, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], np.float64)
    share = np.bincount(y.astype(np.int64), minlength=2)
    weight = len(y) / 2 / np.maximum(share, 1)
    return fit_trees(x, y, weight[y.astype(np.int64)] if len(y) else y)


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``held_out`` is (parts, part): labels of rows whose crc32(id as text) has
    remainder ``part`` are never read. ``score`` is higher the likelier label
    1; 0.5 for all if nothing is labelled. Null text counts as empty; a null
    id is held out; repeated rows are rows like others; an empty table gives an
    empty result; other columns are ignored.
    """
    parts, part = held_out
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, held_out, label_col, id_col, text_col, per_class))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", parts) == part, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
