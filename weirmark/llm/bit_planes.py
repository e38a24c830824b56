"""Centroid clustering over bit planes.

A component is an integer; plane b of a vector is one 64-bit word that holds
bit b of each of its components, the last plane having the weight of the sign
in two's complement. The product of a vector and a centroid is then the sum,
over all pairs of planes, of the weights times the number of bits set in both
words, and all of it stays exact. Sums of the members of a cluster come from
the same words: the members that have a bit set are counted by place.

Planes are written once; a round reads nothing else. A task returns a sum for
each cluster and component, so what a round shuffles doesn't grow with the
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, materialise

#: Components of a vector: as many as a word has bits.
DIMS = 64
#: Bits of a component beside its sign; with more, distances might not fit 64 bits.
MOST_BITS = 27
#: Vectors whose words are looked at together; bounds what a task holds.
ROWS = 4096

SUMS = "cluster int, component int, total long, members long"


def plane_weights(planes: int) -> np.ndarray:
    """What a set bit of each plane stands for; the last is the sign's."""
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Words (rows, planes) of integer vectors (rows, DIMS)."""
    place = np.arange(DIMS, dtype=np.uint64)
    words = np.empty((len(values), planes), np.uint64)
    for b in range(planes):
        words[:, b] = np.bitwise_or.reduce((values >> b & 1).astype(np.uint64) << place, axis=1)
    return words


def products(words: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Inner products (rows, centroids) of vectors and centroids, both as words."""
    weights, found = plane_weights(words.shape[1]), np.zeros((len(words), len(against)), np.int64)
    for k, centroid in enumerate(against):
        for q, word in enumerate(centroid):
            if word:
                common = np.bitwise_count(words & word).astype(np.int64)
                found[:, k] += (common @ weights) * weights[q]
    return found


def squares(words: np.ndarray) -> np.ndarray:
    """Each vector's product with itself."""
    weights, found = plane_weights(words.shape[1]), np.zeros(len(words), np.int64)
    for p in range(words.shape[1]):
        found += (np.bitwise_count(words & words[:, p : p + 1]).astype(np.int64) @ weights) * weights[p]
    return found


def component_sums(words: np.ndarray) -> np.ndarray:
    """Sum of each component over all vectors."""
    rows, planes = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words.astype("<u8")).view(np.uint8).reshape(rows, planes, 8), axis=2, bitorder="little")
    return plane_weights(planes) @ bits.sum(axis=0, dtype=np.int64)


def nearest(words: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of equals, and the squared distance to it."""
    far = own[:, None] - 2 * products(words, to_planes(centroids, words.shape[1])) + (centroids * centroids).sum(axis=1)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(far)), cluster]


def _words(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for s in range(0, batch.num_rows, ROWS):
        part = batch.slice(s, ROWS)
        words = part.column("planes").flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
        yield part, words, part.column("square").to_numpy()


def _pack(planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                words = to_planes(part.column("x").flatten().to_numpy().reshape(-1, DIMS), planes)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * planes)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(words.ravel().view(np.int64))), pa.array(squares(words))], names=["vec_id", "planes", "square"])

    return run


def _round(centroids: np.ndarray):
    """Sums and sizes of the clusters, of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, members = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, words, square in _words(batch):
                cluster, _ = nearest(words, square, centroids)
                members += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += component_sums(words[cluster == c])
        c = np.repeat(np.flatnonzero(members), DIMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(np.tile(np.arange(DIMS, dtype=np.int32), len(c) // DIMS)), pa.array(total[members > 0].ravel()), pa.array(members[c])], names=["cluster", "component", "total", "members"]
        )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, square in _words(batch):
                cluster, far = nearest(words, square, centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, x) of the vectors of DIMS finite components, x being floor(scale * component)."""

    def finite(x: Column) -> Column:
        # Tested as doubles: NaN is neither smaller nor larger than the bounds in Spark's order, so it is named.
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == DIMS) & F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("x"))


def bit_plane_clusters(vectors: DataFrame, k: int, rounds: int, scale: float, seed: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly 64 components, none null or non-finite, take part, each
    component as floor(scale * component); others have no row. Centroids start
    as the ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that
    order; rows that repeat an id are ordered by their components, a null id
    comes after all others. With fewer than ``k`` vectors there are so many
    centroids. Each of ``rounds`` rounds moves every vector to the nearest
    centroid (squared distance; the smaller number of equals) and every
    centroid that has vectors to the floor of their mean; then all are assigned
    once more. Repeated rows are vectors of their own; an empty table gives an
    empty result; other columns are ignored. Components of 2**27 and more,
    whose distances might not fit 64 bits, are refused.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors, id_col, vector_col, scale)
    with Scratch() as keep:
        widest = rows.agg(F.max(F.greatest(F.array_max("x"), -(F.array_min("x") + 1))).alias("m")).first()["m"]
        if widest is not None and widest >= 1 << MOST_BITS:
            raise ValueError(f"a scaled component of {widest} is too large for exact distances of 64 bits")
        planes = int(widest or 0).bit_length() + 1
        order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("x")]
        centroids = np.array([r["x"] for r in rows.orderBy(*order).limit(k).collect()], np.int64).reshape(-1, DIMS)
        packed = keep(rows.mapInArrow(_pack(planes), "vec_id long, planes array<long>, square long"), "planes")
        for _ in range(rounds if len(centroids) else 0):
            moved = packed.mapInArrow(_round(centroids), SUMS).groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
            centroids = centroids.copy()
            for r in moved.collect():  # k * DIMS rows at most
                centroids[r["cluster"], r["component"]] = int(r["total"]) // r["members"]
        assigned = materialise(packed.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    marks = spark.createDataFrame(marks, "own int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(marks), F.col("cluster") == F.col("own")).drop("own")  # a row per cluster
