"""SimHash near-dedup with a binary trie self-join.

Fingerprints of 64 bits link when they differ in at most ``max_bits`` bits.
Equal fingerprints are collapsed first. The 64 bits are cut into
``max_bits + 1`` blocks: two linked fingerprints agree in at least one of
them. For each block there is one binary trie whose paths begin with that
block, and the subtries below a whole block's path are dealt over the tasks;
the error budget inside the block's path is zero in that trie, which loses
nothing because the other tries cover the rest. In a task, subtries are
walked together, node pair by node pair: differing bits add up on the way down
and a pair is pruned when they exceed the budget.

A subtrie that holds very many fingerprints is dealt as pairs of random tiles,
so no task gets more than two tiles of it. A partition is sorted by subtrie and
walked some whole subtries at a time, so a task holds two tiles and ``ROWS``
rows at most, however large its partition. Tasks return spanning forests of the
links they find, at most one edge per row, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, keyed, materialise, unused, whole_groups
from weirmark.llm.components import components

#: Seed of the shingle hash, also the fixed seed of Spark's own xxhash64.
SEED = 42
#: Fingerprints of a tile: this share of all, so that at most 2,000 subtries per trie are split, within these limits.
TILE_SHARE = 1 / 2000
TILE_LEAST, TILE_MOST = 1024, 1 << 17
#: Rows of whole subtries that a task walks together.
ROWS = 1 << 18
PAIR_CHUNK = 1 << 21


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The 64-bit SimHash of ``text``: unsigned, zero when it has no words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_in_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words_in_shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(words_in_shingle), "doc_id long, fp long")


def block_widths(blocks: int, bits: int = 64) -> list[int]:
    return [bits // blocks + (i < bits % blocks) for i in range(blocks)]


def _ranges(lo: np.ndarray, hi: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Where the sorted fingerprints of each node turn from bit 0 to bit 1."""
    return hi - (ones[hi] - ones[lo])


def trie_pairs(keys: np.ndarray, group_starts: np.ndarray, group_stops: np.ndarray, bits: int, budget: int, chunk: int = PAIR_CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``keys`` within ``budget`` differing bits, within groups; ``chunk`` node pairs are walked at a time.

    ``keys`` are sorted inside each group, which is one subtrie; its nodes are
    ranges of that order. Only the low ``bits`` bits may differ in a group.
    """
    many = group_stops - group_starts > 1
    lo, hi = group_starts[many], group_stops[many]
    stack = [(bits - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    prefix_ones: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > chunk:
            for s in range(0, len(alo), chunk):
                stack.append((bit, *(x[s : s + chunk] for x in (alo, ahi, blo, bhi, diff))))
            continue
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        if leaves.any():  # what is left of both paths is compared at once
            i, j = alo[leaves], blo[leaves]
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~leaves] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or bit < 0:
            continue
        if bit not in prefix_ones:
            prefix_ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        ones = prefix_ones[bit]
        same = alo == blo
        am, bm = _ranges(alo, ahi, ones), _ranges(blo, bhi, ones)
        children = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am[~same], ahi[~same], blo[~same], bm[~same], diff[~same] + 1)]
        parts = [np.concatenate(x) for x in zip(*children, strict=True)]
        alo, ahi, blo, bhi, diff = parts
        live = (ahi > alo) & (bhi > blo) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if live.any():
            stack.append((bit - 1, *(x[live] for x in parts)))


def _hang(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j, all links at once, until each pair shares a root."""
    while len(i):
        ri, rj = parent[i], parent[j]
        apart = ri != rj
        if not apart.any():
            return
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


DEALT = ("block", "path", "tile_a", "tile_b")


def _subtries(blocks: int, budget: int, most: int):
    """Walk the subtries of a sorted partition, ``most`` rows of whole ones at a time; yields (fp, root fp) of their forests."""
    widths = block_widths(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, DEALT, most):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            task = np.stack([rows.column(c).to_numpy() for c in DEALT], axis=1)
            block = task[:, 0]
            rest = np.empty_like(fps)
            for b in range(blocks):  # rotate: the block's path first, the other bits in order after it
                own, low = block == b, sum(widths[:b])
                below = fps[own] & np.uint64((1 << low) - 1)
                above = fps[own] >> np.uint64(low + widths[b]) if low + widths[b] < 64 else np.zeros(int(own.sum()), np.uint64)
                rest[own] = below | (above << np.uint64(low))
            new = np.concatenate(([True], (task[1:] != task[:-1]).any(axis=1)))
            starts = np.flatnonzero(new)
            order = np.lexsort((rest, np.cumsum(new)))
            fps, rest = fps[order], rest[order]
            parent = np.arange(len(fps))
            for i, j in trie_pairs(rest, starts, np.append(starts[1:], len(fps)), 64 - min(widths), budget):
                _hang(parent, i, j)
            hung = np.flatnonzero(parent != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[hung].view(np.int64)), pa.array(fps[parent[hung]].view(np.int64))], names=["fp", "root"])

    return run


def near_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root): a forest whose trees are linked by the pairs of ``distinct`` (fp) within ``max_bits`` bits; written to the shared folder."""
    blocks = max_bits + 1
    widths = block_widths(blocks)
    total = distinct.count()
    tile = min(max(TILE_LEAST, int(total * TILE_SHARE)), TILE_MOST)
    paths = [F.shiftrightunsigned("fp", sum(widths[:b])).bitwiseAND(F.lit((1 << w) - 1)) for b, w in enumerate(widths)]
    tried = distinct.select("fp", F.posexplode(F.array(*paths)).alias("block", "path"))
    large = tried.groupBy("block", "path").count().where(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    with Scratch() as made:
        # Written, so that Spark knows its size when it chooses whether to broadcast it: a row for each tile of a trie at most.
        tiled = tried.join(made(large, "large"), ["block", "path"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        dealt = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("fp", "block", "path", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"))
        whole = dealt.repartition(*DEALT).sortWithinPartitions(*DEALT)
        return materialise(whole.mapInArrow(_subtries(blocks, max_bits, ROWS), "fp long, root long"), "forest")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Two texts link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id that links reach, the row's own
    included. A-Z is lower-cased, words end at ASCII white space, a text of
    fewer words than a shingle is one shingle, a null or wordless text has
    fingerprint zero and links like any other. A null id counts as larger than
    any other and its component is null only if no row there has an id.
    Repeated rows share fingerprint and component; an empty table gives an
    empty result; other columns are ignored.
    """
    with Scratch() as made:
        printed = made(fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
        distinct = made(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        links = made.own(near_links(distinct.select("fp"), max_bits))
        forest = made.own(components(links.select(F.col("fp").alias("u"), F.col("root").alias("v"))))
        rooted = distinct.join(forest, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = made(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
        found = printed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return materialise(found, "classified")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id.

    A null id counts as larger than any other; of rows that share the smallest
    id of a component one stays. Null and wordless texts link with each other;
    texts are taken whole; an empty table gives an empty result; columns come
    as they were.
    """
    (rid,) = unused(docs, "__rid")
    rows = keyed(docs, id_col, rid)
    found = simhash_components(rows, rid, text_col, words_in_shingle, max_bits)
    return keep_smallest(rows, rid, found.select("doc_id", F.col("component_id").alias("root")), id_col).select(*docs.columns)


def keep_smallest(rows: DataFrame, rid: str, rooted: DataFrame, id_col: str) -> DataFrame:
    """Of each root of ``rooted`` (doc_id: a key ``rid`` of ``rows``, root) the row with the smallest id."""
    (kept,) = unused(rows, "__kept")
    ids = rows.select(F.col(rid).alias("doc_id"), F.col(id_col).cast("long").alias("i"))
    order = F.struct(F.col("i").isNull(), "i", "doc_id")
    best = rooted.join(ids, "doc_id").groupBy("root").agg(F.min(order)["doc_id"].alias(kept)).select(kept)
    return rows.join(best.hint("shuffle_hash"), F.col(rid) == F.col(kept), "left_semi")
