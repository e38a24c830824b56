"""Packing into optimal length buckets.

A global histogram of lengths is cut into buckets by dynamic programming so
that padding every document to its bucket's boundary adds the fewest tokens.
Inside a bucket, documents form batches of one shape under a token budget.

The histogram has one row per distinct length, so its size is bounded by the
longest document, not by their number. The cost of a bucket satisfies the
quadrangle inequality, so the best last cut never moves back as the range
grows; each layer of the programme is solved by halving, level by level, in
O(n log n) steps, and the boundaries are optimal at every size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmark.llm.common import materialise

#: Documents and full batches in one numbered chunk of a bucket, on average: whichever are more documents. Few batches, as a chunk of long texts is ordered with its texts.
CHUNK, CHUNK_BATCHES = 64, 16


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _layer(before: np.ndarray, lengths: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths with one bucket more than ``before``, and where that bucket begins."""
    n = len(lengths)
    now, came = np.empty(n + 1, c.dtype), np.zeros(n + 1, np.int64)
    now[0] = before[0]
    # Ranges of j still open, and of where their last bucket may begin.
    lo, hi, first, last = np.array([1]), np.array([n]), np.array([0]), np.array([n - 1])
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(mid - 1, last) - first + 1
        ends = np.cumsum(sizes)
        i = np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        j = np.repeat(mid, sizes)
        cost = before[i] + lengths[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
        least = np.minimum.reduceat(cost, ends - sizes)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        of = np.searchsorted(ends, hit, side="right")
        best = i[hit[np.unique(of, return_index=True)[1]]]  # the first of equals
        now[mid], came[mid] = least, best
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, best), (best, last)))
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return now, came


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The longest length of each bucket, with the least padding of all ways to cut ``lengths`` (distinct, rising)."""
    n, k = len(lengths), min(buckets, len(lengths))
    if not n:
        return []
    # Exact integers: 64 bits if the largest sum fits, else Python's own.
    kind = np.int64 if int(lengths[-1]) * int(counts.sum()) < 2**61 else object
    lengths, counts = lengths.astype(kind), counts.astype(kind)
    zero = np.zeros(1, kind)
    c, s = np.concatenate((zero, np.cumsum(counts))), np.concatenate((zero, np.cumsum(counts * lengths)))
    best = lengths[np.maximum(np.arange(n + 1) - 1, 0)] * c - s  # one bucket
    came = []
    for _ in range(k - 1):
        best, cut = _layer(best, lengths, c, s)
        came.append(cut)
    ends, j = [], n
    for cut in reversed(came):
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    if j:
        ends.append(int(lengths[j - 1]))
    return ends[::-1]


def pack(lengths: DataFrame, buckets: int = 16, token_budget: int = 16384, id_col: str = "doc_id", length_col: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: doc_id, n_tokens, bucket, boundary, batch_id, slot, padding, then the columns of ``keep``.

    Rows of one ``batch_id`` share a bucket, and rows times boundary stay
    within ``token_budget``; a document longer than the budget is a batch of
    its own, never cut. Rows of a bucket are dealt at random into chunks of
    about ``CHUNK`` documents or ``CHUNK_BATCHES`` batches, and each chunk is numbered apart: no
    bucket is ever ordered in one task, at the price of one part-filled batch
    per chunk. Null or negative lengths count as 0; null and repeated ids are
    rows like others; an empty table gives an empty result; other columns are
    ignored.
    """
    if clash := {c.lower() for c in keep} & {"doc_id", "n_tokens", "bucket", "boundary", "batch_id", "slot", "padding", "per_batch", "chunks", "chunk", "place", "salt"}:
        raise ValueError(f"keep would give these columns twice: {sorted(clash)}")
    rows = lengths.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"), *keep)
    # Lengths are often dear to count, and read twice. Once written, ``salt`` is fixed; it spreads rows that are equal.
    rows = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "lengths")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    n, count = histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    boundaries = bucket_boundaries(n, count, buckets)
    bucket, per_batch, chunks = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(boundaries))):
        inside = F.col("n_tokens") <= end
        rows_in = int(count[(n <= end) & (n > (boundaries[i - 1] if i else -1))].sum())
        batch = max(1, token_budget // max(1, end))
        bucket = F.when(inside, i).otherwise(bucket)
        per_batch = F.when(inside, batch).otherwise(per_batch)
        chunks = F.when(inside, max(1, math.ceil(rows_in / max(CHUNK, CHUNK_BATCHES * batch)))).otherwise(chunks)
    ends = F.array(*map(F.lit, boundaries)).cast("array<long>")
    dealt = rows.withColumns({"bucket": bucket, "per_batch": per_batch, "chunks": chunks})
    dealt = dealt.withColumn("boundary", F.get(ends, F.col("bucket"))).withColumn("chunk", F.pmod(F.xxhash64("salt"), F.col("chunks")).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("n_tokens", "doc_id")) - 1
    return dealt.withColumn("place", place).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "boundary",
        F.format_string("%d-%d-%d", "bucket", "chunk", F.floor(F.col("place") / F.col("per_batch"))).alias("batch_id"),
        (F.col("place") % F.col("per_batch")).cast("int").alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
        *keep,
    )
