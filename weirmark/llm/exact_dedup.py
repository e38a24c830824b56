"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort
puts equal texts next to each other, and one pass over each sorted partition
compares neighbours in full.

The sort key is (first bytes, 64-bit hash, id) for the splitters and
(first bytes, hash, text, id) inside a partition. The id is part of the
splitters' key, so a text that a third of all rows share is spread over many
partitions. A run of equal texts that touches an edge of its partition may go
on in the next one; those runs, a few per partition whatever the input, are
merged by their SHA-256 and sent back by broadcast.

Defined cases: null text counts as empty; a null id ranks behind every other
id; rows that repeat an id are rows of their own, and of equal winners exactly
one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import ascii_lower, materialise, unused

#: Bytes of text in the splitters. Longer keys would only move more to the driver.
PREFIX = 32

RUNS = "doc_id long, text_sha256 binary, part int, best long, size long, first_best boolean, edge boolean"
RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.binary()), ("part", pa.int32()), ("best", pa.int64()), ("size", pa.int64()), ("first_best", pa.bool_()), ("edge", pa.bool_())])


def _runs(largest: bool):
    """Neighbour comparison over one sorted partition; keeps ids and digests, never texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ids, known, starts, digests, hashes, n = None, [], [], [], [], [], 0
        for batch in batches:
            hashed = batch.column("hash")
            for i, text in enumerate(batch.column("norm")):
                text = text.as_py()
                if text != before:
                    before = text
                    starts.append(n + i)
                    digests.append(hashlib.sha256(text).digest())
                    hashes.append(hashed[i].as_py())
            doc_ids = batch.column("doc_id")
            known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False))
            ids.append(doc_ids.fill_null(0).to_numpy())
            n += batch.num_rows
        if not n:
            return
        ids, known = np.concatenate(ids), np.concatenate(known)
        starts = np.array(starts)
        sizes = np.diff(np.append(starts, n))
        run = np.repeat(np.arange(len(starts)), sizes)
        lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        ranked = np.where(known, ids, lowest if largest else highest)
        best = (np.maximum if largest else np.minimum).reduceat(ranked, starts)
        any_known = np.logical_or.reduceat(known, starts)
        wins = np.flatnonzero((ranked == best[run]) & (known | ~any_known[run]))
        first = np.zeros(n, bool)
        first[wins[np.unique(run[wins], return_index=True)[1]]] = True
        edge = np.array([h in (hashes[0], hashes[-1]) for h in hashes])
        part = np.full(n, TaskContext.get().partitionId(), np.int32)
        sha = pa.array(digests, pa.binary())
        for a in range(0, n, 20_000):
            r = run[a : a + 20_000]
            b = a + len(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a:b], mask=~known[a:b]), sha.take(pa.array(r)), pa.array(part[a:b]), pa.array(best[r], mask=~any_known[r]), pa.array(sizes[r]), pa.array(first[a:b]), pa.array(edge[r])],
                schema=RUNS_ARROW,
            )

    return scan


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest``: the id of the row that stays in
    each group of equal texts (equal after lower-casing A-Z).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", F.col("norm").cast("binary").alias("norm"), F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash"))
    sorted_rows = rows.repartitionByRange("prefix", "hash", "doc_id").sortWithinPartitions("prefix", "hash", "norm", "doc_id")
    runs = materialise(sorted_rows.select("doc_id", "norm", "hash").mapInArrow(_runs(keep == "largest"), RUNS), "runs")
    better = F.max if keep == "largest" else F.min
    # One row per run at an edge: at most two per partition, unless hashes collide.
    edges = runs.where("edge and first_best").groupBy("text_sha256").agg(
        better("best").alias("all_best"),
        F.sum("size").alias("all_size"),
        (F.min_by("part", F.struct(F.col("best").isNull(), -F.col("best") if keep == "largest" else F.col("best"), "part"))).alias("winner"),
    )
    joined = runs.alias("r").join(F.broadcast(edges.withColumn("edge", F.lit(True))), ["text_sha256", "edge"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("all_size").isNotNull(), F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first_best") & (F.coalesce("winner", "part") == F.col("part"))).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns as they were."""
    own_id, own_sha, sha = unused(docs, "__id", "__sha", "__sha_of")
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias(own_id), F.unhex("text_sha256").alias(own_sha))
    hashed = docs.withColumn(sha, F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)))
    found = hashed.join(kept.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha)), "left_semi")
    repeated = docs.groupBy(F.col(id_col)).count().where("count > 1").limit(1).count() > 0
    if repeated:  # identical rows share id and text: one of them stays
        found = found.dropDuplicates([id_col, sha])
    return found.drop(sha)
