"""Best-fit packing of token sequences after a dominance reduction.

How many sequences are needed depends on the lengths alone, and there are only
as many different lengths as a sequence has tokens. So the plan is made from
the histogram of lengths, whatever the number of documents:

1. Reduction (Martello and Toth): a set of at most three lengths that fills one
   sequence at least as well as any other set with the longest of them is fixed,
   as often as the counts allow, and the instance shrinks. No optimum is lost.
2. Best fit, longest first, of what is left. Sequences of the same content are
   one entry with a count, so that a length costs as many steps as there are
   different contents, not documents.

Pieces are numbered within their length, in the task that encodes them and from
there on by sums over tasks; the plan says which numbers of a length go to
which sequences and at what place. Nothing but counts is shuffled or sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, materialise
from weirmark.llm.token_counts import _cuts_at_spaces, _encoder, tokenizer_digest
from weirmark.llm.units import _SEPARATORS

#: Bytes of text and number of texts that are encoded together.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 14
#: Distinct pieces of text whose ids a task keeps.
KEPT_UNITS = 1 << 18
#: Pieces of text that are handed to the tokenizer as one.
JOINED = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# --- plan ------------------------------------------------------------------


def dominant_sets(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths that are in some best packing, each with how often; they are taken from ``counts``, which has the number of each length.

    For a length w, every other set with w that fits must be dominated: its
    members can be put, one or several together, in place of single members of
    the set that is fixed.
    """
    size, found, changed = len(counts) - 1, [], True

    def fix(*lengths: int) -> None:
        times = min(int(counts[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            counts[x] -= times
        found.append((lengths, times))

    while changed:
        changed = False
        w = size
        while w:
            if not counts[w]:
                w -= 1
                continue
            counts[w] -= 1
            own = np.flatnonzero(counts)
            least = np.repeat(own[:3], np.minimum(counts[own[:3]], 3))[:3]
            several = counts[own] > 1
            counts[w] += 1
            room, fixed = size - w, None
            if not len(own) or own[0] > room:
                fixed = (w,)
            else:
                k = int(own[np.searchsorted(own, room, side="right") - 1])
                if k == room or len(least) < 2 or least[0] + least[1] > room:
                    fixed = (w, k)
                elif len(least) < 3 or least.sum() > room:
                    fixed = _pair_or_three(w, k, room, own, several)
            if fixed:
                fix(*fixed)
                changed = True
            else:
                w -= 1
    return found


def _pair_or_three(w: int, k: int, room: int, own: np.ndarray, several: np.ndarray) -> tuple[int, ...] | None:
    """The set that dominates all others where at most two lengths fit beside ``w``, ``k`` being the longest that does."""
    # The longest partner a of each length b, a not shorter than b.
    at = np.searchsorted(own, room - own, side="right") - 1
    good = (at > np.arange(len(own))) | ((at == np.arange(len(own))) & several)
    b, sums = own[good], own[good] + own[at[good]]
    if not len(b) or sums.max() <= k:
        return w, k
    beside = own[(own <= room - k) & ((own != k) | several)]
    if len(beside) and not ((b > beside[-1]) & (sums > k)).any():
        return w, k, int(beside[-1])
    return None


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first: contents of sequences, as lengths with their number, each with how many sequences have it."""
    size = len(counts) - 1
    bins: list[list] = []  # room, number, contents; by room
    for w in range(size, 0, -1):
        left = int(counts[w])
        if not left:
            continue
        after = [x for x in bins if x[0] < w]
        for room, number, content in bins[len(after) :]:
            each = room // w
            full = min(number, left // each)
            left -= full * each
            if full:
                after.append([room - each * w, full, [*content, (w, each)]])
            if full < number and left:  # fewer than a sequence has room for
                after.append([room - left * w, 1, [*content, (w, left)]])
                full, left = full + 1, 0
            if full < number:
                after.append([room, number - full, content])
        each = size // w
        if left >= each:
            after.append([size - each * w, left // each, [(w, each)]])
        if left % each:
            after.append([size - left % each * w, 1, [(w, left % each)]])
        bins = sorted(after, key=lambda x: x[0])
    return [(content, number) for _, number, content in bins]


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Contents of sequences and how many have each; ``counts`` has the number of pieces of each length from 0 on."""
    counts = counts.astype(np.int64).copy()
    fixed = [([(x, lengths.count(x)) for x in dict.fromkeys(lengths)], times) for lengths, times in dominant_sets(counts)]
    return fixed + best_fit(counts)


def places(planned: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Of each length: rows (first number, number in a sequence, first sequence, place there), by first number."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, number in planned:
        at = 0
        for length, each in content:
            rows.setdefault(length, []).append((taken.get(length, 0), each, sequence, at))
            taken[length] = taken.get(length, 0) + number * each
            at += length * each
        sequence += number
    return {length: np.array(own, np.int64) for length, own in rows.items()}


# --- tokens ----------------------------------------------------------------


class Words:
    """Pieces of texts between spaces, by place, each with the space before it; ``joined`` are those beside which white space may go on."""

    def __init__(self):
        self.texts: list[str] = []
        self.joined: set[int] = set()
        self._bare: dict[str, int] = {}
        self._spaced: dict[str, int] = {}

    def _add(self, table: dict[str, int], key: str, unit: str) -> int:
        place = table[key] = len(self.texts)
        self.texts.append(unit)
        if not key or key[0].isspace() or key[-1].isspace() or _SEPARATORS.search(key):
            self.joined.add(place)
        return place

    def cut(self, text: str) -> np.ndarray | None:
        """Places of the pieces of ``text``, in order; None if it can't be cut at its spaces."""
        first, *later = text.split(" ")
        places = [self._bare.get(first), *map(self._spaced.get, later)]
        if None in places:
            if places[0] is None:
                places[0] = self._add(self._bare, first, first)
            for i, x in enumerate(places):
                if x is None:
                    key = later[i - 1]
                    x = self._spaced.get(key)
                    places[i] = self._add(self._spaced, key, " " + key) if x is None else x
        if self.joined and not self.joined.isdisjoint(places):
            return None
        return np.array(places, np.int64)


class Encoder:
    """Ids of texts; equal pieces between spaces are encoded once, as long as the tokenizer allows it."""

    def __init__(self, tokenizer, at_spaces: bool):
        self.tokenizer, self.at_spaces = tokenizer, at_spaces
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.units, self.ids, self.starts, self.sizes = Words(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        found = [np.array(x.ids, np.uint32) for a in range(0, len(texts), 2048) for x in self.tokenizer.encode_batch_fast(texts[a : a + 2048], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self) -> None:
        """Encode the pieces that are new. Those that begin with a space are encoded in a row: only their first id has a space."""
        done, new = len(self.sizes), self.units.texts[len(self.sizes) :]
        spaced = [i for i, x in enumerate(new) if x[0:1] == " " and done + i not in self.units.joined]
        ids, sizes = self._encode(["".join([new[i] for i in spaced[a : a + JOINED]]) for a in range(0, len(spaced), JOINED)])
        at = np.flatnonzero(self.leads[ids])
        ends = np.cumsum(sizes)
        rows = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(sizes))
        starts, length = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        as_told = len(at) == len(spaced) and (rows[:-1] == JOINED).all() and self.leads[ids[ends - sizes]].all()
        if as_told:
            starts[spaced], length[spaced] = at, np.diff(np.append(at, len(ids)))
            kept = set(spaced)
            alone = [i for i in range(len(new)) if i not in kept] if len(spaced) < len(new) else []
        else:
            ids, alone = ids[:0], list(range(len(new)))
        more, sizes = self._encode([new[i] for i in alone])
        starts[alone], length[alone] = len(ids) + np.cumsum(sizes) - sizes, sizes
        self.starts, self.sizes = np.append(self.starts, starts + len(self.ids)), np.append(self.sizes, length)
        self.ids = np.concatenate([self.ids, ids, more])

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cuts = [self.units.cut(x) if self.at_spaces and not any(s in x for s in self.special) else None for x in texts]
        self._learn()
        for text, cut in zip(texts, cuts, strict=True):
            if cut is None:
                yield self._encode([text])[0]
                continue
            sizes = self.sizes[cut]
            ends = np.cumsum(sizes)
            yield self.ids[np.repeat(self.starts[cut] - ends + sizes, sizes) + np.arange(ends[-1])]
        if len(self.sizes) > KEPT_UNITS:
            self._forget()


def _cut(shared, digest: str, at_spaces: bool, size: int, end: int):
    """The pieces of each text, numbered within their length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        encoder, part, seen = Encoder(_encoder(shared, digest), at_spaces), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)

        def block(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, tokens in zip(ids, encoder.block(texts), strict=True):
                tokens = np.append(tokens, np.uint32(end)).astype("<u4")
                first = (len(tokens) - 1) % size + 1
                for piece, b in enumerate(range(first, len(tokens) + 1, size)):
                    a = max(0, b - size) if piece else 0
                    row = (doc_id, piece, a, b - a, zlib.crc32(tokens[a:b]), part, seen[b - a])
                    seen[b - a] += 1
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in PIECES.split(", ")])

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(texts) >= BLOCK_ROWS:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield block(ids, texts)

    return run


def _place(planned: dict[int, np.ndarray]):
    """Sequence and place of each piece, from its number within its length."""
    lengths = sorted(planned)
    rows = np.concatenate([planned[x] for x in lengths])
    begin = np.zeros(max(lengths) + 2, np.int64)
    for x in lengths:
        begin[x + 1] = len(planned[x])
    begin = np.cumsum(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = begin[x] + np.searchsorted(rows[begin[x] : begin[x + 1], 0], number[own], side="right") - 1
            first, each, sequence, offset = rows[at].T
            i = number - first
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence + i // each), pa.array(offset + i % each * length)], names=[x.split(" ")[0] for x in PLACED.split(", ")])

    return run


def best_fit_pack(docs: DataFrame, tokenizer_path: str, size: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids that the tokenizers library gives for its whole text,
    without added special tokens, and then ``end``. One of more than ``size``
    ids is cut into pieces of ``size``, of which the first may be shorter. Every
    sequence holds pieces of at most ``size`` ids together, without gaps from
    place 0 on. Null text counts as empty, so it is ``end`` alone; null and
    repeated ids are documents like others; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    model = open(tokenizer_path, "rb").read()
    shared = spark.sparkContext.broadcast(model)  # one tokenizer file, a few MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with Scratch() as keep:
        pieces = keep(rows.mapInArrow(_cut(shared, tokenizer_digest(model), _cuts_at_spaces(model), size, end), PIECES), "pieces")
        found = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
        counts = np.zeros(size + 1, np.int64)
        for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, ``size`` at most
            counts[r["length"]] = r["n"]
        if not counts.any():
            return spark.createDataFrame([], PLACED)
        before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        numbers = found.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
        numbered = pieces.join(numbers, ["part", "length"]).withColumn("number", F.col("rank") + F.col("before"))
        return materialise(numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_place(places(plan(counts))), PLACED), "packed")
