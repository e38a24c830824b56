"""Exact top-k search by inner product: a Voronoi kNN join.

Every vector belongs to the cell of its nearest pivot, a vector of the table
itself; the pivots grow with the rows. A cell is cut into rings by distance to
its pivot. Per ring a summary is kept: its size, its outer distance and its
largest norm. The scores of a query with the pivots, which are rows, give a
score that k others surely reach, and the summaries an upper bound for every
ring; the query is compared only with the rings whose bound reaches that score.
Small rings are put together into tiles, from the summaries alone; a query is
sent once to each tile that it asks, with the list of the rings it asks there.
Large rings and the queries of a tile are cut into blocks of bounded size, and
a block of data meets a block of queries in one task, by one matrix product for
each ring, so neither a hot cell nor a hot vector meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmark.llm.common import Scratch, materialise

#: Pivots of a table: one for so many rows, within these limits, which also bound what is collected for the summaries.
PIVOT_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 64, 64, 4096
#: Rings of a cell, at most.
MOST_RINGS = 8
#: A block of data has at most a BLOCKS-th of the rows, within these limits.
BLOCKS, LEAST_ROWS, MOST_ROWS = 64, 512, 32_768
#: Components of a block of queries.
QUERY_LONGS = 8 << 20
#: Queries are routed so many at a time that bounds for all rings, and vectors for all tiles, have at most this many numbers.
ROUTE_CELLS = 4 << 20
#: Scores that a task holds at a time.
SCORES = 1 << 20
#: Candidates for a pivot that are expected to meet in one task, as a multiple of the pivots.
FOUND = 4


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length: where they stand, and the vectors as one matrix."""
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        where = np.flatnonzero(sizes == dim)
        yield where, column.take(pa.array(where)).flatten().to_numpy().reshape(-1, dim)


class Pivots:
    """Pivots of each length of vector; cells are numbered through all lengths."""

    def __init__(self, drawn: list[list[int]], most: dict[int, int]):
        self.of: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        cells = 0
        for dim in sorted(most):
            own = np.unique(np.array([v for v in drawn if len(v) == dim], np.float64).reshape(-1, dim), axis=0)
            own = own[np.random.default_rng(1).permutation(len(own))[: most[dim]]]
            self.of[dim], self.first[dim] = own, cells
            cells += len(own)


def _cells(pivots: Pivots):
    """Cell, distance to its pivot and norm of every row; the last two rounded up, so that the bounds made from them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance, norm = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for where, v in _by_length(batch.column("v")):
                x, own = v.astype(np.float64), pivots.of[v.shape[1]]
                near = ((own**2).sum(axis=1) - 2 * x @ own.T).argmin(axis=1)
                cell[where] = near + pivots.first[v.shape[1]]
                distance[where] = np.sqrt(((x - own[near]) ** 2).sum(axis=1)) * (1 + 1e-9)
                norm[where] = np.sqrt((x**2).sum(axis=1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance), pa.array(norm)], names=[*batch.schema.names, "cell", "distance", "norm"])

    return run


def _routes(pivots: Pivots, rings: dict[int, Rings], k: int):
    """A query's tiles and, in each, its rings: those whose upper bound reaches the (k + 1)-th best score with a pivot; its own row may be one of k + 1.

    ``least`` is that score, rounded down: k other rows reach it, so none below it is wanted.
    """

    def route(v: np.ndarray, own: np.ndarray, r: Rings) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        q = v.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
        centre = q @ own.T
        reached = np.partition(centre, len(own) - k - 1, axis=1)[:, len(own) - k - 1] if len(own) > k else np.full(len(q), -np.inf)
        upper = np.minimum(centre[:, r.pivot] + norm[:, None] * r.outer, norm[:, None] * r.norm)
        slack = 1e-6 * np.abs(upper) + 1e-9 * norm[:, None] * r.norm + 1  # far more than what doubles may have rounded
        hit = upper + slack >= reached[:, None]
        counts = np.add.reduceat(hit, r.starts, axis=1, dtype=np.int32)
        row, tile = np.nonzero(counts)
        offsets = np.concatenate(([0], np.cumsum(counts[row, tile]))).astype(np.int32)
        rounded = 1e-6 * np.abs(reached) + 1e-9 * norm * r.norm.max() + 1
        return row, r.tile[r.starts[tile]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(r.place[np.nonzero(hit)[1]])), np.where(np.isfinite(reached), reached - rounded, -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, v in _by_length(batch.column("v")):
                r = rings[v.shape[1]]
                step = max(ROUTE_CELLS // max(len(r.tile), len(r.starts) * v.shape[1]), 1)
                for a in range(0, len(v), step):
                    row, tile, asked, least = route(v[a : a + step], pivots.of[v.shape[1]], r)
                    take = pa.array(where[a + row])
                    yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(tile), asked, pa.array(least[row])], names=["query", "query_id", "q", "tile", "places", "least"])

    return run


def _tile(k: int):
    none = np.iinfo(np.int64).min

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        # Scores fit 64 bits; where a double could round them they are computed as integers.
        most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ x.T

    def best(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each line, the smaller id first among equals."""
        if score.shape[1] > 4 * k:
            # What is below the k-th score goes; equals of it stay until their ids are compared.
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            kept = score >= kth[:, None]
            width = int(kept.sum(axis=1).max())
            place = np.argsort(~kept, axis=1, kind="stable")[:, :width]
            score, ids = np.where(np.take_along_axis(kept, place, axis=1), np.take_along_axis(score, place, axis=1), none), np.take_along_axis(ids, place, axis=1)
        order = np.lexsort((ids, ~score), axis=1)[:, :k]
        return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def solve(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ("query", "query_id", "vec_id", "score")
        if data.empty or queries.empty:
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        q, query = np.stack(queries["q"].to_numpy()), queries["query"].to_numpy()
        asks = np.repeat(np.arange(len(q)), queries["places"].str.len().to_numpy())
        places = np.concatenate(queries["places"].to_numpy())
        by_place = np.argsort(places, kind="stable")
        asks, places = asks[by_place], places[by_place]
        top, found = np.full((len(q), k), none), np.zeros((len(q), k), np.int64)
        for place, own in data.groupby("place"):
            x, ids, rids = np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy(), own["rid"].to_numpy()
            asked = asks[slice(*np.searchsorted(places, [place, place + 1]))]
            step = max(SCORES // len(x), 1)
            for a in range(0, len(asked), step):
                part = asked[a : a + step]
                score = scores(q[part], x)
                score[query[part][:, None] == rids] = none
                top[part], found[part] = best(np.hstack([top[part], score]), np.hstack([found[part], np.broadcast_to(ids, score.shape)]))
        row, place = np.nonzero((top != none) & (top >= queries["least"].to_numpy()[:, None]))
        return pd.DataFrame(dict(zip(names, (query[row], queries["query_id"].to_numpy()[row], found[row, place], top[row, place]), strict=True)))

    return solve


class Rings:
    """The rings of one length of vector, in tiles: small rings share one, a large ring has its own and is cut into blocks."""

    def __init__(self, found: list, first_cell: int, first_tile: int, block: int):
        self.cell, self.ring, rows = (np.array([r[f] for r in found]) for f in ("cell", "ring", "n"))
        self.outer, self.norm = (np.array([r[f] for r in found]) for f in ("outer", "norm"))
        self.pivot = self.cell - first_cell
        tile, place, held = [], [], block + 1
        for n in rows.tolist():
            alone = held + n > block
            tile.append(tile[-1] + alone if tile else first_tile)
            place.append(0 if alone else place[-1] + 1)
            held = n if alone else held + n
        self.tile, self.place = np.array(tile, np.int32), np.array(place, np.int32)
        self.starts = np.flatnonzero(self.place == 0)
        self.blocks = np.ceil(rows / block).astype(int)
        self.ends = int(self.tile[-1]) + 1


def _drawn(rows: DataFrame, sizes: dict[int, int], most: dict[int, int]) -> list[list[int]]:
    """Candidates for the pivots of each length, by the hash of their row. A threshold keeps all but a few rows from the task that sorts them."""
    share = F.lit(0.0)
    for dim, n in sizes.items():
        share = F.when(F.size("v") == dim, F.lit(FOUND * most[dim] / n)).otherwise(share)
    small = rows.where(F.xxhash64("rid") / F.lit(2.0**64) + 0.5 < share)
    place = F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("rid"), "rid"))
    wanted = F.lit(0)
    for dim in sizes:
        wanted = F.when(F.size("v") == dim, F.lit(2 * most[dim])).otherwise(wanted)
    return [r["v"] for r in small.withColumn("place", place).where(F.col("place") <= wanted).select("v").collect()]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best others.

    Vectors are scaled and floored to integers; the score is their inner
    product, exact; ties go to the smaller id. ``is_query`` marks the query
    rows; ``pivots`` is their number for each length of vector. Rows with a
    null id, a null or empty vector, or a null or non-finite component take no
    part. Vectors are compared with those of their own length. Rows that
    repeat an id are rows of their own: each is a candidate for the others, and
    each that asks gets its own ranks. Vectors whose scores might not fit 64
    bits are refused with a ValueError. Fewer than ``k`` candidates give fewer
    rows; an empty table gives an empty result; other columns are ignored.
    """
    with Scratch() as keep:
        return _top_k(vectors, is_query, k, scale, id_col, vector_col, pivots, keep)


def _top_k(vectors: DataFrame, is_query: Column, k: int, scale: float, id_col: str, vector_col: str, pivots: int | None, keep: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    largest = F.array_max(F.transform("x", lambda x: F.abs(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))))
    # Once written, the key of a row is fixed.
    rows = keep(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "asks", scaled(F.col("x"), scale).alias("v"), largest.alias("largest")), "vectors")
    result = "query_id long, rank int, vec_id long, score long"
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("largest").alias("m")).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    if any(r["m"] ** 2 * r["dim"] >= 2.0**62 for r in lengths):
        raise ValueError("the components are too large for scores of 64 bits")
    sizes = {r["dim"]: r["n"] for r in lengths}
    most = {dim: pivots or min(max(n // PIVOT_ROWS, LEAST_PIVOTS), MOST_PIVOTS) for dim, n in sizes.items()}
    rows = rows.drop("largest")
    centres = Pivots(_drawn(rows, sizes, most), most)

    placed = keep(rows.mapInArrow(_cells(centres), "rid long, vec_id long, asks boolean, v array<long>, cell int, distance double, norm double"), "cells")
    count = min(max(sum(sizes.values()) // sum(most.values()) // LEAST_ROWS, 1), MOST_RINGS)
    cuts = placed.groupBy("cell").agg(F.percentile_approx("distance", [i / count for i in range(1, count + 1)], 1000).alias("cuts"))
    cuts = F.broadcast(keep(cuts.withColumn("cuts", F.slice("cuts", 1, count - 1)), "cuts"))  # one row per pivot
    ring = F.size(F.filter("cuts", lambda c: c < F.col("distance")))
    ringed = placed.join(cuts, "cell").withColumn("ring", ring)
    summary = ringed.groupBy("cell", "ring", F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("distance").alias("outer"), F.max("norm").alias("norm")).orderBy("cell", "ring").collect()
    block = min(max(sum(sizes.values()) // BLOCKS, LEAST_ROWS), MOST_ROWS)
    rings, tiles = {}, 0
    for dim in sorted(sizes):
        rings[dim] = Rings([r for r in summary if r["dim"] == dim], centres.first[dim], tiles, block)
        tiles = rings[dim].ends
    queries = rows.where("asks").select("rid", "vec_id", "v")
    routed = keep(queries.mapInArrow(_routes(centres, rings, k), "query long, query_id long, q array<long>, tile int, places array<int>, least double"), "routes")
    asked = {r["tile"]: r["count"] for r in routed.groupBy("tile").count().collect()}  # one row per tile

    most_asks = max(block, QUERY_LONGS // max(sizes))
    plan = [(int(c), int(g), int(t), int(p), int(b), math.ceil(asked[t] / most_asks)) for r in rings.values() for c, g, t, p, b in zip(r.cell, r.ring, r.tile, r.place, r.blocks, strict=True) if t in asked]
    plan = spark.createDataFrame(plan, "cell int, ring int, tile int, place int, data_blocks int, query_blocks int")  # one row per ring
    of_tile = F.broadcast(plan.groupBy("tile").agg(F.max("data_blocks").alias("data_blocks"), F.max("query_blocks").alias("query_blocks")))
    key = ["tile", "data_block", "query_block"]
    data = ringed.join(F.broadcast(plan), ["cell", "ring"]).select("rid", "vec_id", "v", "place", "tile", F.pmod(F.xxhash64("rid"), "data_blocks").cast("int").alias("data_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    asks = routed.join(of_tile, "tile").select("query", "query_id", "q", "places", "least", "tile", F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1)).alias("data_block"), F.pmod(F.xxhash64("query"), "query_blocks").cast("int").alias("query_block"))
    local = data.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(_tile(k), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return materialise(local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
