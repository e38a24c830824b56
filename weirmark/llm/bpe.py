"""Byte-level BPE by corpus-level merge replay.

Each task takes its part of the corpus in blocks. The pre-tokens of a block
are collected into one table of distinct words, and the merges are replayed
over that table: an inverted index leads from a pair, named by the rank of the
token it makes, to the word positions where it stands; ranks are taken in
order, all positions of a rank are merged at once, and only the neighbours
they touch get new entries in the index. Documents are then put together from
the words' ids by array gathers. Nothing is shuffled, so hot texts and long
texts cost what their bytes cost.

A block ends when its distinct words or its texts have grown to a bound; a long
text goes on in the next block, cut where no word is. So the corpus is replayed
block by block, a word once in each: one table for all blocks would have to be
joined to every word of every text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.units import Units, parts, unicode_pattern

#: Characters of text, and of distinct words, at which a block ends; a text is cut into parts of at most PART.
BLOCK, DISTINCT, PART = 24 << 20, 4 << 20, 2 << 20
#: Rows and ids that are given out together.
ROWS, IDS = 1000, 4 << 20
#: Positions that are looked up together.
STEP = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)

_built: dict[str, Merges] = {}


class Merges:
    """The ranks of a vocabulary as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every split of a token into two tokens is a pair that makes it.
        made = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs = np.array([p for p, _ in made], np.int64)
        self.pair_ranks = np.array([r for _, r in made], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of ids makes, or NONE."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def one_by_one(self, word: bytes) -> np.ndarray:
        """The merges of a single word, lowest rank first, leftmost first."""
        n = len(word)
        token = self.byte_ids[np.frombuffer(word, np.uint8)]
        pair = np.full(n, NONE, np.int32)
        for a in range(0, n - 1, STEP):
            b = min(a + STEP, n - 1)
            pair[a:b] = self.rank_of(token[a:b], token[a + 1 : b + 1])
        waiting = (pair.astype(np.int64) << 32 | np.arange(n))[pair < NONE].tolist()
        heapq.heapify(waiting)
        token, pair, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (token, pair, np.arange(1, n + 1), np.arange(-1, n - 1)))
        tokens, ranks = self.tokens, self.ranks

        def enter(i: int) -> None:
            pair[i] = ranks.get(tokens[token[i]] + tokens[token[after[i]]], NONE) if after[i] < n else NONE
            if pair[i] < NONE:
                heapq.heappush(waiting, pair[i] << 32 | i)

        while waiting:
            rank, i = divmod(heapq.heappop(waiting), 1 << 32)
            if pair[i] != rank:
                continue
            j = after[i]
            token[i], token[j], pair[j], after[i] = rank, -1, NONE, after[j]
            if after[i] < n:
                before[after[i]] = i
            enter(i)
            if before[i] >= 0:
                enter(before[i])
        found = np.frombuffer(token, np.int32)
        return found[found >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's count of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n = int(ends[-1]) if len(words) else 0
        token = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.int32(0))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends[lengths > 0] - 1], before[starts[lengths > 0]] = n, n  # n stands for no neighbour
        live = np.ones(n, bool)
        pair = np.full(n + 1, NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts) if len(cuts) else [positions], strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(waiting, rank)

        waiting: list[int] = []
        for a in range(0, n, STEP):
            own = np.arange(a, min(a + STEP, n), dtype=np.int32)
            own = own[after[own] < n]
            pair[own] = self.rank_of(token[own], token[after[own]])
            own = own[pair[own] < NONE]
            if len(own):
                enter(own, pair[own])
        out_of_order: set[int] = set()
        while waiting:
            rank = heapq.heappop(waiting)
            left = np.unique(np.concatenate(index.pop(rank)))
            left = left[pair[left] == rank]
            if not len(left):
                continue
            right = after[left]
            if len(left) > 1 and (left[1:] == right[:-1]).any():  # overlaps, as in a run of one letter: leftmost first
                place = np.arange(len(left))
                run = np.maximum.accumulate(np.where(np.concatenate(([True], left[1:] != right[:-1])), place, 0))
                taken = (place - run) % 2 == 0
                left, right = left[taken], right[taken]
            beyond = after[right]
            token[left] = rank
            after[left], before[beyond] = beyond, left
            live[right] = False
            pair[right] = pair[left] = NONE
            prior = before[left]
            touched = np.concatenate((left[beyond < n], prior[prior < n]))
            if not len(touched):
                continue
            ranks = self.rank_of(token[touched], token[after[touched]])
            pair[touched] = ranks
            if (ranks < rank).any():  # a word whose ranks do not rise is encoded on its own
                out_of_order.update(np.searchsorted(ends, touched[ranks < rank], side="right").tolist())
            found = ranks < NONE
            if found.any():
                enter(touched[found], ranks[found])
        ids = token[:n][live]
        counts = np.diff(np.concatenate(([0], np.cumsum(live)))[np.concatenate((starts, [n]))]) if len(words) else lengths
        own = {i: np.array([self.ranks[w]]) for i, w in enumerate(words) if w in self.ranks}
        own |= {i: self.one_by_one(words[i]) for i in out_of_order if i not in own}
        bad = {i: v for i, v in own.items() if counts[i] != len(v)} | {i: own[i] for i in out_of_order}
        if bad:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for i, v in bad.items():
                split[i] = v.astype(np.int32)
            ids, counts = np.concatenate(split), np.fromiter(map(len, split), np.int64, len(split))
        return ids, counts

    def encode(self, texts: Iterable[str], find) -> Iterator[np.ndarray]:
        """Ids of each text. ``find`` gives the pre-tokens of a text."""
        units, cuts, size, held = Units(find), [], 0, []

        def block() -> Iterator[np.ndarray]:
            places: dict[str, int] = {}
            found = [find(u) for u in units.texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            words = np.fromiter((places.setdefault(w, len(places)) for ws in found for w in ws), np.int64, int(sizes.sum()))
            ids, counts = self.replay([w.encode() for w in places])
            offsets = np.cumsum(counts) - counts
            unit_ids = ids[gather(offsets[words], counts[words])]
            ends = np.concatenate(([0], np.cumsum(counts[words])))[np.concatenate(([0], np.cumsum(sizes)))]
            for cut, last in cuts:
                held.append(unit_ids[gather(ends[cut], ends[cut + 1] - ends[cut])])
                if last:
                    yield held[0] if len(held) == 1 else np.concatenate(held)
                    held.clear()

        for text in texts:
            own = list(parts(text, PART))
            for i, part in enumerate(own):
                cuts.append((units.cut(part), i + 1 == len(own)))
                size += len(part)
                if units.size >= DISTINCT or size >= BLOCK:
                    yield from block()
                    units, cuts, size = Units(find), [], 0
        if cuts:
            yield from block()

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[gather(self.offsets[ids], self.lengths[ids])].tobytes()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all the ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _merges(shared, digest: str) -> Merges:
    if digest not in _built:
        _built.clear()
        _built[digest] = Merges(read_ranks(shared.value))
    return _built[digest]


def _encode(shared, digest: str, pattern: str, summarise: bool):
    def summary(merges: Merges, ids: np.ndarray) -> tuple:
        decoded = hashlib.sha256()
        for a in range(0, len(ids), STEP):
            decoded.update(merges.decode(ids[a : a + STEP]))
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).digest(), decoded.digest()

    def out(keys: list, made: list) -> pa.RecordBatch:
        own = pa.array(keys[: len(made)], pa.int64())
        del keys[: len(made)]
        if summarise:
            return pa.RecordBatch.from_arrays([own, pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary()), pa.array([x[2] for x in made], pa.binary())], names=["doc_id", "n_tokens", "ids_digest", "decoded_digest"])
        return pa.RecordBatch.from_arrays([own, pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, find = _merges(shared, digest), regex.compile(unicode_pattern(pattern)).findall
        keys: list[int | None] = []  # of texts whose ids have not been given out

        def texts() -> Iterator[str]:
            for batch in batches:
                for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    keys.append(key.as_py())
                    yield text.as_py()

        made, size = [], 0
        for ids in merges.encode(texts(), find):
            made.append(summary(merges, ids) if summarise else ids)
            size += len(ids)
            if len(made) >= ROWS or size >= IDS:
                yield out(keys, made)
                made, size = [], 0
        if made:
            yield out(keys, made)

    return run


def _decode(shared, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared, digest)
        for batch in batches:
            texts = [merges.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return run


def _share(spark, ranks_path: str):
    data = open(ranks_path, "rb").read()  # a vocabulary file of about 1 MB
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``.

    Ids are those of the tiktoken library for whole texts without special
    tokens. Null text counts as empty and has no ids; null and repeated ids of
    documents are rows like others; texts are taken whole, a long one in parts;
    an empty table gives an empty result; other columns are ignored.
    """
    shared, digest = _share(docs.sparkSession, ranks_path)
    return _rows(docs, id_col, text_col).mapInArrow(_encode(shared, digest, pattern, False), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) for each row of (doc_id, ids); null ids decode to nothing, rows that repeat an id are rows like others, an empty table gives an empty result."""
    shared, digest = _share(encoded.sparkSession, ranks_path)
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(shared, digest), "doc_id long, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, without keeping the ids."""
    shared, digest = _share(docs.sparkSession, ranks_path)
    made = _rows(docs, id_col, text_col).mapInArrow(_encode(shared, digest, pattern, True), "doc_id long, n_tokens long, ids_digest binary, decoded_digest binary")
    return made.select("doc_id", "n_tokens", F.lower(F.hex("ids_digest")).alias("ids_sha256"), F.lower(F.hex("decoded_digest")).alias("decoded_sha256"))
