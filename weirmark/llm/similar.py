"""SimHash near-dedup of texts that are similar as sets of word shingles.

Texts of Jaccard similarity 0.8 differ in some 15 % of their SimHash bits, far
more than a trie self-join of whole 64-bit fingerprints can allow. So a text
gets a sketch of 256 bits, cut into eight words, and each word has its own
binary tries: two texts meet where a word of theirs differs in at most
``WORD_BUDGET`` bits. A pair of similarity 0.8 does so in at least one of the
eight words with probability 0.91, one of 0.85 with 0.98. Pairs that meet are
kept if the whole sketches differ in at most ``SKETCH_BUDGET`` bits.

As in ``simhash``, each trie is dealt by whole blocks of its word, large
subtries as pairs of tiles, and tasks, which walk some whole subtries at a
time, return forests, never pairs. Few texts are dealt by one block of four; of
more, paths of 8 bits would hold too many, and they are dealt by two blocks of
five or three of six, in more tries with longer paths. Words within the budget
agree in as many blocks each time, so the same texts meet. The trees
joined are groups of texts that may be similar; whether they are is decided by
the shingles themselves. A group of few texts is compared pair by pair. Of one
of more, every text is compared with the smallest key; if its texts are then
not in one component, it is dealt as pairs of random tiles, and a task compares
only texts of different components and returns a forest of the links.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, keyed, materialise, unused, whole_groups
from weirmark.llm.components import components
from weirmark.llm.simhash import SEED, _hang, block_widths, keep_smallest, trie_pairs

#: Words of a sketch, the bits of one, and the differing bits at which two words are near.
WORDS, WORD_BITS, WORD_BUDGET = 8, 32, 3
#: The blocks that a word is cut into and how many make a path; near words agree in that many, whichever bits differ.
DEALINGS = tuple((WORD_BUDGET + agreed, agreed) for agreed in (1, 2, 3))
#: Differing bits of the whole sketch up to which a pair is looked at: the mean at similarity 0.8 and two deviations and a half.
SKETCH_BUDGET = 53
#: Texts of a group up to which all their pairs become rows.
SMALL = 32
#: A tile has at most twice an even share of a subtrie, within these limits.
TILE_LEAST, TILE_MOST = 16_384, 1 << 18
#: Rows of whole subtries that a task walks together.
ROWS = 1 << 18
#: Texts of a group in one tile.
GROUP_TILE = 1024
#: Pairs, and pairs of nodes, that are looked at together. Near the root hardly a pair of nodes is pruned, so that their chunks are what a task holds.
PAIRS, NODES = 1 << 19, 1 << 16
#: Similarities are ratios of small integers; this is far below their distance.
EPSILON = 1e-9
_MORE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)

_COLUMNS = np.arange(32, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of ``text``, in order; a text of fewer words is one shingle."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.array([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)], np.uint64).view(np.int64))


def sketch(shingle_hashes: np.ndarray) -> np.ndarray:
    """256 SimHash bits of a set of shingle hashes, as four longs; each shingle's hash is mixed anew for each long."""
    h, seen = shingle_hashes.view(np.uint64), np.zeros(32 * 256, np.int64)
    for a in range(0, len(h), 1 << 14):
        x = h[a : a + (1 << 14), None] * _MORE
        x = (x ^ (x >> np.uint64(31))) * _MORE[::-1]
        x ^= x >> np.uint64(29)
        seen += np.bincount((x.view(np.uint8).reshape(len(x), 32) + _COLUMNS).ravel(), minlength=32 * 256)
    ones = seen.reshape(32, 256) @ _BITS  # how often each bit of each byte is set
    return np.packbits((2 * ones > len(h)).ravel(), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(words: int):
    """(rid, sketch, own): the sketch of each text and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                own = [shingles(t.as_py(), words) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), _lists([sketch(x) for x in own]), _lists(own)], names=["rid", "sketch", "own"])

    return run


DEALT = ("trie", "path", "tile_a", "tile_b")


def _subtries(blocks: int, agreed: int, most: int):
    """Walk the subtries of a sorted partition, ``most`` rows of whole ones at a time; yields (u, v), forests of the texts that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, DEALT, most):
            yield _forest(rows, blocks, agreed)

    return run


def _forest(rows: pa.Table, blocks: int, agreed: int) -> pa.RecordBatch:
    """(u, v): a forest of the texts that meet in the subtries of ``rows``."""
    rid = rows.column("rid").to_numpy()
    sketches = np.concatenate([c.flatten().to_numpy() for c in rows.column("sketch").chunks]).view(np.uint64).reshape(len(rid), 4)
    task = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in DEALT], axis=1)
    choices, widths = list(itertools.combinations(range(blocks), agreed)), block_widths(blocks, WORD_BITS)
    word, choice = task[:, 0] // len(choices), task[:, 0] % len(choices)
    value = sketches[np.arange(len(rid)), word // 2] >> (32 * (word % 2)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    # The bits of the word without those of its path, which the subtrie has in common.
    rest, free = np.zeros_like(value), 0
    for c in np.unique(choice):
        own, at = choice == c, 0
        for b in range(blocks):
            if b not in choices[c]:
                rest[own] |= (value[own] >> np.uint64(sum(widths[:b])) & np.uint64((1 << widths[b]) - 1)) << np.uint64(at)
                at += widths[b]
        free = max(free, at)
    new_trie = np.concatenate(([True], (task[1:] != task[:-1]).any(axis=1)))
    order = np.lexsort((rest, np.cumsum(new_trie)))
    rid, sketches, rest = rid[order], sketches[order], rest[order]
    new_key = new_trie | np.concatenate(([True], rest[1:] != rest[:-1]))
    key_at = np.flatnonzero(new_key)  # rows of one key lie together
    key_end = np.append(key_at[1:], len(rid))
    starts = np.flatnonzero(new_trie[key_at])
    parent = np.arange(len(rid))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1) <= SKETCH_BUDGET
        _hang(parent, i[near], j[near])

    join(np.repeat(key_at, key_end - key_at), np.arange(len(rid)))
    left: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for i, j in itertools.chain(trie_pairs(rest[key_at], starts, np.append(starts[1:], len(key_at)), free, WORD_BUDGET, NODES), [(None, None)]):
        if i is not None:
            left.append((i, j))
            waiting += len(i)
        if left and (i is None or waiting >= PAIRS):
            i, j = (np.concatenate(x) for x in zip(*left, strict=True))
            left, waiting = [], 0
            join(key_at[i], key_at[j])
            # Rows beyond the first of a key, in slices of bounded size.
            many = (key_end[i] - key_at[i]) * (key_end[j] - key_at[j])
            i, j, many = i[many > 1], j[many > 1], many[many > 1]
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS, prepend=0))
            for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(i)), strict=True):
                for p, q in _members(key_at, key_end, i[a:b], j[a:b], many[a:b]):
                    join(p, q)
    hung = np.flatnonzero(parent != np.arange(len(rid)))
    return pa.RecordBatch.from_arrays([pa.array(rid[hung]), pa.array(rid[parent[hung]])], names=["u", "v"])


def _members(at: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the pairs of keys, PAIRS at a time."""
    ends = np.cumsum(many)
    for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        n = np.arange(a, min(a + PAIRS, int(ends[-1])))
        pair = np.searchsorted(ends, n, side="right")
        n = n - (ends[pair] - many[pair])
        width = (end - at)[j[pair]]
        yield at[i[pair]] + n // width, at[j[pair]] + n % width


def dealing(total: int, most: int) -> tuple[int, int]:
    """Of ``DEALINGS`` the one that writes each of ``total`` texts least often, if a tile holds ``most`` of them."""

    def copies(way: tuple[int, int]) -> int:
        return math.comb(*way) * max(1, math.ceil((total >> _path_bits(*way)) / most))

    return min(DEALINGS, key=copies)


def _path_bits(blocks: int, agreed: int) -> int:
    """Bits of the shortest path."""
    return sum(block_widths(blocks, WORD_BITS)[-agreed:])


def _paths(blocks: int, agreed: int) -> Column:
    """The paths of a text in its tries: of each word, one for every choice of blocks."""
    widths = block_widths(blocks, WORD_BITS)
    made = []
    for w in range(WORDS):
        for chosen in itertools.combinations(range(blocks), agreed):
            path, at = F.lit(0).cast("long"), 0
            for b in chosen:
                bits = F.shiftrightunsigned(F.col("sketch")[w // 2], WORD_BITS * (w % 2) + sum(widths[:b])).bitwiseAND(F.lit((1 << widths[b]) - 1))
                path, at = path.bitwiseOR(F.shiftleft(bits, at)), at + widths[b]
            made.append(path.cast("int"))
    return F.array(*made)


def candidate_groups(sketches: DataFrame, made: Scratch, way: tuple[int, int] | None = None) -> DataFrame:
    """(rid, h): the texts of ``sketches`` (rid, sketch) that meet others, by group; ``way`` is one of ``DEALINGS``."""
    total = sketches.count()
    way = way or dealing(total, TILE_MOST)
    tried = sketches.select("rid", "sketch", F.posexplode(_paths(*way)).alias("trie", "path"))
    tile = min(max(TILE_LEAST, 2 * total >> _path_bits(*way)), TILE_MOST)
    large = tried.groupBy("trie", "path").count().where(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    # Written, so that Spark knows its size when it chooses whether to broadcast it: a row for each tile of a trie at most.
    tiled = tried.join(made(large, "large"), ["trie", "path"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = tiled.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("rid", "sketch", "trie", "path", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"))
    forest = dealt.repartition(*DEALT).sortWithinPartitions(*DEALT).mapInArrow(_subtries(*way, ROWS), "u long, v long")
    grouped = made.own(components(made(forest, "met")))
    return grouped.select(F.col("node").alias("rid"), F.col("root").alias("h")).union(grouped.select(F.col("root").alias("rid"), F.col("root").alias("h")).distinct())


def _compared(least: float):
    """The pairs (u, v) whose sets a and b are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= least * (len(a) + len(b) - both) - EPSILON)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def forest_of(sets: list[np.ndarray], parts: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Links between similar sets that join parts which are not joined yet; all of them together join what is similar."""
    sizes = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    held = doc[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token, minlength=len(names)))
    starts = np.concatenate(([0], ends[:-1]))
    mine = np.split(token, np.cumsum(sizes)[:-1])
    _, parts = np.unique(parts, return_inverse=True)
    largest = np.bincount(parts).argmax()  # its texts are met from the others' side
    for i in np.flatnonzero(parts != largest).tolist():
        both = np.bincount(np.concatenate([held[starts[t] : ends[t]] for t in mine[i].tolist()]), minlength=len(sets))
        near = both >= least * (sizes[i] + sizes - both) - EPSILON
        while (others := np.flatnonzero(near & (parts != parts[i]))).size:
            j = int(others[0])
            yield i, j
            parts[parts == parts[j]] = parts[i]


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("h", "tile_a", "tile_b", "rid", "root")), (x.values.to_numpy() for x in batch.column("own")), strict=True)

        for _, group in itertools.groupby(rows(), key=lambda r: r[:3]):
            group = list(group)
            links = list(forest_of([r[5] for r in group], np.array([r[4] for r in group]), least))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([group[i][3] for i, _ in links], pa.int64()), pa.array([group[j][3] for _, j in links], pa.int64())], names=["u", "v"])

    return run


def similar_roots(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, root) of each row of ``rows`` (rid long, a key; text): the smallest key that links reach."""
    with Scratch() as made:
        sets = made(rows.mapInArrow(_sets(words), "rid long, sketch array<long>, own array<long>"), "sets")
        grouped = candidate_groups(sets.select("rid", "sketch"), made)
        sizes = grouped.groupBy("h").agg(F.count("*").alias("m"))
        held = made(grouped.join(sizes, "h"), "held")
        own = sets.select("rid", "own").join(held.select("rid"), "rid", "left_semi")
        few, many = held.where(F.col("m") <= SMALL), held.where(F.col("m") > SMALL)
        small = few.select("h", F.col("rid").alias("u")).join(few.select("h", F.col("rid").alias("v")), "h").where("u < v").select("u", "v")
        pairs = made(small.union(many.where("h < rid").select(F.col("h").alias("u"), F.col("rid").alias("v"))), "pairs")
        sided = pairs.join(own.select(F.col("rid").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("rid").alias("v"), F.col("own").alias("b")), "v")
        links = made(sided.select("u", "v", "a", "b").mapInArrow(_compared(least), "u long, v long"), "near")
        roots = made.own(components(links))
        # Groups of many texts that are not all of one component yet.
        labelled = many.join(roots, F.col("rid") == F.col("node"), "left").select("h", "rid", F.coalesce("root", "rid").alias("root"))
        labelled = made(labelled, "labelled")
        apart = labelled.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        apart = made(apart.select("h", F.ceil(F.col("m") / GROUP_TILE).cast("int").alias("tiles")), "apart")
        if apart.limit(1).count():
            dealt = labelled.join(apart, "h").withColumn("own_tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            dealt = dealt.select("h", "rid", "root", F.least("own_tile", "other").alias("tile_a"), F.greatest("own_tile", "other").alias("tile_b"))
            keys = ["h", "tile_a", "tile_b"]
            whole = dealt.join(own, "rid").select(*keys, "rid", "root", "own").repartition(*keys).sortWithinPartitions(*keys)
            more = made(whole.mapInArrow(_tiles(least), "u long, v long"), "more")
            roots = made.own(components(links.union(more)))
        found = sets.select("rid").join(roots, F.col("rid") == F.col("node"), "left").select(F.col("rid").alias("doc_id"), F.coalesce("root", "rid").alias("root"))
        return materialise(found, "roots")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of texts that links join, the row with the smallest id.

    Two texts link when they meet in a trie of their sketches, or in a chain of
    such texts, and the sets of their shingles of ``words`` words have a Jaccard
    similarity of ``least`` or more. A-Z is lower-cased and words end at ASCII
    white space; a text of fewer words is one shingle, so null and wordless
    texts link. Texts are taken whole. A null id counts as larger than any
    other; rows that repeat an id are told apart, and of rows that share the
    smallest id of a component one stays. An empty table gives an empty result;
    columns come as they were.
    """
    (rid,) = unused(docs, "__rid")
    rows = keyed(docs, id_col, rid)
    rooted = similar_roots(rows.select(F.col(rid).alias("rid"), F.col(text_col).alias("text")), words, least)
    return keep_smallest(rows, rid, rooted, id_col).select(*docs.columns)
