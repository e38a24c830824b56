"""Suffix-array dedup: depth-limited radix sort of suffixes.

Suffixes are told apart only through ``window`` bytes. Sorting them is grouping
them by their digits, most significant first; a group that has one member is
done, and the groups that are left at full depth are the repeated windows.

The first digit is not the first bytes of a suffix but the bytes at its
*anchor*: the ``gram`` bytes inside the window whose hash is smallest. Equal
windows have equal anchors at equal distances, so all windows that share an
anchor are sorted at once, and about 1 suffix in 80 has to be shuffled. The
passes over what is left:

1. anchor: anchors whose gram occurs once are done, with all their windows;
2. context: anchors with equal bytes around them, from the first byte of the
   first possible window to the last byte of the last, repeat all their windows;
3. blocks of window offsets: the bytes common to all windows of a block must
   occur twice, else no window of it does; blocks whose windows are all equal
   repeat them all;
4. single windows of the blocks that are still open;
5. bytes: what passes 2 to 4 take for equal is compared byte by byte.

In passes 1 to 4 a digit goes by a hash of its bytes, which can only tell
digits apart. So what differs is done; what may be equal is a claim: these
bytes of a text and those of the group's first text. Claims that continue each
other are joined into runs, and pass 5 brings the bytes of a run and of its
counterpart together. Should they differ, a hash having met by chance, all
windows that this can touch are grouped by their bytes themselves. No hash ever
decides that bytes are equal.

Groups are counted, never collected: each pass aggregates (key, count) before
it shuffles and joins the keys that occur twice back, so a passage that a third
of all documents share costs a task no more than others. A counterpart that
very many runs have is copied to as many tasks as they need. Long texts are cut
into pieces with margins; windows and what stands around them are whole in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import Scratch, keyed, materialise, release, unused

WINDOW = 200
GRAM = 40
#: Bytes of text hashed at a time; a longer text is cut into pieces of so many.
BUFFER = 1 << 18
#: Window offsets in a block of pass 3: fewer make more blocks and fewer single windows.
BLOCK = 14
#: Flags of an anchor: its context occurs twice; it stands for that context in the next passes.
SETTLED, SOURCE = 1, 2
#: Runs that one copy of their counterpart serves.
SHARE = 2048
#: Bits of the hashes. Fewer make more work, never another result.
BITS = 64

_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S32, _S33 = np.uint64(32), np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * _MIX
    return x ^ (x >> _S32)


class _Powers:
    """Powers of each base and of its inverse, as long as they have been needed."""

    def __init__(self):
        self.size, self.up, self.down = 0, (), ()

    def need(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * BUFFER)
            self.up = tuple(self._run(b) for b in _BASES)
            self.down = tuple(self._run(np.uint64(pow(int(b), -1, 1 << 64))) for b in _BASES)

    def _run(self, base: np.uint64) -> np.ndarray:
        steps = np.full(self.size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_powers = _Powers()


class Hashed:
    """Hashes of any ranges of a byte array; equal for equal bytes, wherever they stand."""

    def __init__(self, data: np.ndarray, bits: int = BITS):
        n = len(data)
        _powers.need(n + 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.sums = []
        for k in range(2):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[k][data] * _powers.up[k][:n], out=sums[1:])
            self.sums.append(sums)

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        a, b = ((s[stops] - s[starts]) * _powers.down[k][starts] for k, s in enumerate(self.sums))
        return _mix(_mix(a) + b * _BASES[0] + (stops - starts).astype(np.uint64)) & self.mask

    def grams(self, size: int) -> np.ndarray:
        s = self.sums[0]
        n = len(s) - size
        return _mix((s[size:] - s[:-size]) * _powers.down[0][:n]) & self.mask if n > 0 else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, begin: np.ndarray, counts: np.ndarray, window: int, gram: int, bits: int = BITS) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows in ``data``, of which ``counts`` in a row start at each ``begin``.

    Returns the hashes, and per anchor its position, its gram's hash, and the
    first and last start of the windows whose anchor it is. The leftmost of
    equal smallest grams counts.
    """
    hashed = Hashed(data, bits)
    grams = hashed.grams(gram)
    order = (_mix(grams) >> _S32 << _S32) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(order, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(counts)
    windows = np.repeat(begin - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
    at = at[windows]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at)) - 1 if len(new) else new
    return hashed, at[new], grams[at[new]], windows[new], windows[last]


class Pieces:
    """Some texts, or a piece of one with what stands around it, in one byte string.

    ``starts`` and ``stops`` bound each text there, ``offsets`` is what is to be
    added to a place in it for the place in the whole text, and windows start
    at ``counts`` places from ``begin`` on.
    """

    def __init__(self, columns: list[list], texts: list[bytes], window: int):
        self.columns, self.joined = columns, b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.begin = self.stops - sizes
        self.offsets, self.counts = -self.starts, np.maximum(sizes - window + 1, 0)

    def narrow(self, begin: int, count: int, offset: int) -> Pieces:
        self.begin, self.counts, self.offsets = np.array([begin]), np.array([count]), np.array([offset])
        return self

    def anchors(self, window: int, gram: int, bits: int):
        return anchors(np.frombuffer(self.joined, np.uint8), self.begin, self.counts, window, gram, bits)


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str], window: int, piece: int) -> Iterator[Pieces]:
    """Texts of about ``piece`` bytes at a time; of a longer text its pieces, each on its own."""
    kept, texts, size = [[] for _ in columns], [], 0
    for batch in batches:
        values = [batch.column(c) for c in columns]
        for i, text in enumerate(batch.column("text")):
            own, text = [v[i].values if pa.types.is_list(v.type) else v[i].as_py() for v in values], text.as_py()
            if len(text) > 2 * piece:
                for a in range(0, len(text) - window + 1, piece):
                    left = max(0, a - window)
                    whole = Pieces([[v] for v in own], [text[left : a + piece + 2 * window]], window)
                    yield whole.narrow(a - left, min(piece, len(text) - window + 1 - a), left)
                continue
            for k, v in zip(kept, own, strict=True):
                k.append(v)
            texts.append(text)
            size += len(text)
            if size >= piece:
                yield Pieces(kept, texts, window)
                kept, texts, size = [[] for _ in columns], [], 0
    if texts:
        yield Pieces(kept, texts, window)


def _context(p, starts, stops, window, gram):
    """Where the bytes of all possible windows of an anchor begin and end, within its text."""
    return np.maximum(p - (window - gram), starts), np.minimum(p + window, stops)


def own_repeats(data: np.ndarray, starts: np.ndarray, of: np.ndarray, p: np.ndarray, grams: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which anchors have only windows that stand once more further to the left in their text, told by the bytes; and the runs of these windows.

    Each is compared with what the nearest anchor of the same gram before it
    has. Runs are (text, start, stop, distance to the double).
    """
    order = np.lexsort((p, grams, of))
    same = (of[order[1:]] == of[order[:-1]]) & (grams[order[1:]] == grams[order[:-1]])
    own, back = order[1:][same], (p[order[1:]] - p[order[:-1]])[same]
    good = first[own] - back >= starts[of[own]]
    own, back = own[good], back[good]
    order = np.lexsort((first[own], back, of[own]))
    own, back = own[order], back[order]
    settled, equal = np.zeros(len(p), bool), np.zeros(len(own), bool)
    if len(own):
        start, stop = first[own], last[own] + window
        new, reach = _run_marks(of[own], start, stop, np.zeros(len(own), np.int64), back)
        at = np.append(np.flatnonzero(new), len(own))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            a, b, d = int(start[i]), int(reach[j - 1]), int(back[i])
            wrong = a + np.flatnonzero(data[a:b] != data[a - d : b - d])
            equal[i:j] = np.searchsorted(wrong, start[i:j]) == np.searchsorted(wrong, stop[i:j])
    own, back = own[equal], back[equal]
    settled[own] = True
    text, start, stop, _, double = joined_runs(of[own], first[own], last[own] + window, np.zeros(len(own), np.int64), first[own] - back)
    return settled, (text, start, stop, start - double)


def _anchor_rows(window: int, gram: int, bits: int, piece: int):
    """(gram, context, rid, at) of every anchor; what repeats within its text is settled at once: (rid, at, stop).

    A window that equals an earlier one of its text needs no further look: it
    repeats, and the earlier one stands for it. So a text of short period has
    as many anchors as its period and pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _pieces(batches, ["rid"], window, piece):
            data = np.frombuffer(x.joined, np.uint8)
            hashed, p, grams, first, last = x.anchors(window, gram, bits)
            of, rids = np.searchsorted(x.stops, p, side="right"), np.array(x.columns[0], np.int64)
            settled, (text, start, stop, shift) = own_repeats(data, x.starts, of, p, grams, first, last, window)
            p, grams, of = p[~settled], grams[~settled], of[~settled]
            a, b = _context(p, x.starts[of], x.stops[of], window, gram)
            around = _mix(hashed.ranges(a, b) + (p - a).astype(np.uint64)) & hashed.mask
            names, n = ["gram", "around", "rid", "at", "stop"], len(p)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), pa.array(rids[of]), pa.array(p + x.offsets[of]), pa.nulls(n, pa.int64())], names=names)
            if len(text):
                # A run and its double, which overlap if the run is longer than their distance.
                overlap = stop - start >= shift
                text, a, b = np.append(text, text[~overlap]), np.append(np.where(overlap, start - shift, start), (start - shift)[~overlap]), np.append(stop, (stop - shift)[~overlap])
                salt = _mix((rids[text] ^ a).view(np.uint64)).view(np.int64)  # deals them out; meets no gram
                off = x.offsets[text]
                yield pa.RecordBatch.from_arrays([pa.array(salt), pa.nulls(len(a), pa.int64()), pa.array(rids[text]), pa.array(a + off), pa.array(b + off)], names=names)

    return run


def _run_marks(text: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted claims: whether each begins a run, and where what has been joined up to it stops."""
    group = np.concatenate(([False], (text[1:] != text[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1]))).cumsum()
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(group * far + stop)
    return np.concatenate(([True], group[1:] * far + start[1:] > reach[:-1])), reach - group * far


def joined_runs(text: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims that bytes of a text equal those of another, joined where they touch and go on alike."""
    shift = other_start - start
    order = np.lexsort((start, shift, other, text))
    text, start, stop, other, shift = (x[order] for x in (text, start, stop, other, shift))
    if not len(text):
        return text, start, stop, other, shift
    new, reach = _run_marks(text, start, stop, other, shift)
    at = np.flatnonzero(new)
    return text[at], start[at], reach[np.append(at[1:] - 1, len(new) - 1)], other[at], start[at] + shift[at]


CONTEXTS = "rid long, at long, before int, low int, high int, context binary, stop long, src_rid long, src_at long"


def _context_rows(window: int, gram: int, bits: int, piece: int):
    """Of each text's shared anchors: the claims of those whose context is shared, as runs; the contexts of the others.

    One text of each shared context gives its context too, so that open anchors
    are compared with it as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _pieces(batches, ["rid", "anchors"], window, piece):
            _, p, _, first, last = x.anchors(window, gram, bits)
            of = np.searchsorted(x.stops, p, side="right")
            sizes = np.fromiter(map(len, x.columns[1]), np.int64, len(x.columns[1]))
            flat = np.stack([np.concatenate([own.field(k).to_numpy() for own in x.columns[1]]) for k in range(3)], axis=1)
            wanted = np.repeat(-x.offsets, sizes) + (flat[:, 0] >> 2)  # four times the place, and two flags
            order = np.argsort(wanted, kind="stable")
            wanted, flat = wanted[order], flat[order]
            where = np.searchsorted(wanted, p)
            where[where == len(wanted)] = 0
            hit = wanted[where] == p if len(wanted) else np.zeros(len(p), bool)
            p, first, last, of, flat = p[hit], first[hit], last[hit], of[hit], flat[where[hit]]
            flags, rids = flat[:, 0] & 3, np.array(x.columns[0], np.int64)
            a, b = _context(p, x.starts[of], x.stops[of], window, gram)
            at = p + x.offsets[of]
            claims = (flags == SETTLED) & (b - a >= window)
            rid, start, stop, src, src_start = joined_runs(rids[of[claims]], at[claims] - (p - a)[claims], at[claims] + (b - p)[claims], flat[claims, 1], flat[claims, 2] - (p - a)[claims])
            n, none = len(rid), lambda kind, n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), none(pa.int32(), n), none(pa.int32(), n), none(pa.int32(), n), none(pa.binary(), n), pa.array(stop), pa.array(src), pa.array(src_start)], schema=_CONTEXTS)
            own = np.flatnonzero(flags != SETTLED)
            n = len(own)
            bytes_ = pa.array([x.joined[i:j] for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids[of[own]]), pa.array(at[own]), pa.array((p - a)[own].astype(np.int32)), pa.array((first - p)[own].astype(np.int32)), pa.array((last - p)[own].astype(np.int32)), bytes_, none(pa.int64(), n), none(pa.int64(), n), none(pa.int64(), n)],
                schema=_CONTEXTS,
            )

    return run


_CONTEXTS = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary()), ("stop", pa.int64()), ("src_rid", pa.int64()), ("src_at", pa.int64())])


def _tables(batches: Iterator[pa.RecordBatch], width: int, bits: int, rows: int = 2048):
    """Contexts as rows of byte arrays, padded; with the batch that they came in."""
    for whole in batches:
        for s in range(0, whole.num_rows, rows):
            batch = whole.slice(s, rows)
            texts = [x.as_py() for x in batch.column("context")]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)
            yield batch, Hashed(flat, bits), np.arange(len(texts)) * width, lengths, batch.column("before").to_numpy().astype(np.int64), batch.column("low").to_numpy().astype(np.int64), batch.column("high").to_numpy().astype(np.int64)


def _block_rows(window: int, gram: int, block: int, bits: int):
    """Every block of an open anchor that holds windows of it: its two keys, and the span of all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, reach = 2 * window - gram, window - gram
        for batch, hashed, base, lengths, before, low, high in _tables(batches, width, bits):
            at = batch.column("at").to_numpy()
            for k in range(-(-(reach + 1) // block)):
                a, b = max(-reach, -(k + 1) * block + 1), -k * block  # offsets of the block's windows
                own = np.flatnonzero((low <= b) & (high >= a))
                if not len(own):
                    continue
                p, n = before[own], lengths[own]
                keys = []
                for i, j in ((np.maximum(p + b, 0), np.minimum(p + a + window, n)), (np.maximum(p + a, 0), np.minimum(p + b + window, n))):
                    # Where the range lies about the anchor, and what the text's ends cut off, is part of the key.
                    keys.append(_mix(hashed.ranges(base[own] + i, base[own] + j) + ((p - i) * 65536 + (j - p) + 1).astype(np.uint64)) & hashed.mask)
                start = at[own] + np.maximum(a, -p)
                stop = at[own] + np.minimum(b + window, n - p)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(take), batch.column("at").take(take), pa.array(np.full(len(own), k, np.int32)), *(pa.array(x.view(np.int64)) for x in keys), pa.array(start << 32 | stop)],
                    names=["rid", "at", "block", "common", "whole", "span"],
                )

    return run


def _window_rows(window: int, gram: int, block: int, bits: int):
    """The single windows of the open blocks: (rid, key, place), the place being the start and 32 more bits of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, reach = 2 * window - gram, window - gram
        for batch, hashed, base, _, before, low, high in _tables(batches, width, bits):
            blocks = batch.column("blocks")
            sizes = pc.list_value_length(blocks).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            k = blocks.flatten().to_numpy().astype(np.int64)
            offset = -(k * block)[:, None] - np.arange(block)[None, :]
            row = np.broadcast_to(of[:, None], offset.shape)
            good = (offset >= low[row]) & (offset <= high[row]) & (offset >= -reach)
            offset, row = offset[good], row[good]
            start = base[row] + before[row] + offset
            key = hashed.ranges(start, start + window)
            more = hashed.ranges(start + 1, start + window - 1) >> _S32  # no more than what place has room for
            place = (batch.column("at").to_numpy()[row] + offset).astype(np.int64) << 32 | more.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(place)], names=["rid", "key", "place"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's claims from all passes, as runs."""
    for batch in batches:
        claims = batch.column("claims")
        text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(claims).to_numpy(zero_copy_only=False))
        flat = claims.flatten()
        text, *rest = joined_runs(text, *(flat.field(k).to_numpy() for k in range(4)))
        yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(text)), *map(pa.array, rest)], names=["rid", "start", "stop", "src_rid", "src_start"])


SLICE = "src_rid long, src_start long, size long, salt int, rid long, start long, bytes binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a text's runs, and of what it is the counterpart for (rid null), once for each of its shares."""
    for batch in batches:
        for rid, text, wanted in zip(batch.column("rid"), batch.column("text"), batch.column("wanted"), strict=True):
            rid, text, rows, size = rid.as_py(), memoryview(text.as_buffer()), [], 0
            for w in wanted.as_py():
                # A claim of hashes that met by chance may reach beyond a text.
                own = bytes(text[w["start"] : w["start"] + w["size"]]) if w["start"] >= 0 else b""
                if w["shares"] is None:
                    rows.append((w["src_rid"], w["src_start"], w["size"], w["salt"], rid, w["start"], own))
                else:
                    rows += [(rid, w["start"], w["size"], salt, None, None, own) for salt in range(w["shares"])]
                size += len(own)
                if size > 4 * BUFFER:
                    yield _sliced(rows)
                    rows, size = [], 0
            if rows:
                yield _sliced(rows)


def _sliced(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.strip().split(" ")[0] for x in SLICE.split(",")])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, start, stop, same): every run and its counterpart, and whether their bytes are equal. A counterpart stands before its runs."""
    key, against = None, b""
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("src_rid", "src_start", "size", "salt", "rid", "start")]
        for src, src_start, size, salt, rid, start, own in zip(*columns, batch.column("bytes"), strict=True):
            if rid is None:
                key, against = (src, src_start, size, salt), own.as_py()
                continue
            assert key == (src, src_start, size, salt), "a run without its counterpart"
            same = own.as_py() == against
            out += [(rid, start, start + size, same), (src, src_start, src_start + size, same)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["rid", "start", "stop", "same"])


def _whole_windows(window: int):
    """(rid, start, bytes): the windows inside a text's ranges, once each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, spans in zip(batch.column("rid"), batch.column("text"), batch.column("spans"), strict=True):
                text, spans = text.as_py(), np.array(spans.as_py(), np.int64)
                starts = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(max(0, s >> 32), min(len(text), s & 0xFFFFFFFF) - window + 1) for s in spans.tolist())]))
                for a in range(0, len(starts), 4096):
                    own = starts[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rid.as_py())), pa.array(own), pa.array([text[s : s + window] for s in own.tolist()], pa.binary())], names=["rid", "start", "bytes"])

    return run


def _bounded(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of a range that is whole characters."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _removed(with_text: bool):
    """Union of each text's spans, and what is left of the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                text, removed, runs, at, left = text.as_py(), 0, 0, 0, []
                for a, b in _union(np.array(spans.as_py(), np.int64)):
                    if with_text:
                        a, b = _bounded(text, a, b)
                    left.append(text[at:a])
                    removed, runs, at = removed + b - a, runs + 1, b
                left.append(text[at:])
                kept = b"".join(left)
                for column, value in zip(out, (removed, runs, kept if with_text else hashlib.sha256(kept).digest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["rid", "n_removed", "n_spans", "kept"])

    return run


def _union(spans: np.ndarray) -> list[list[int]]:
    """Maximal runs of spans given as start * 2**32 + stop."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    a, b = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True))


def _span(start: Column, stop: Column) -> Column:
    return F.shiftleft(start.cast("long"), 32) + stop


def _first(*names: str) -> list[Column]:
    """Of a group: how many there are, and one that stands for it, of the least row."""
    return [F.count("*").alias("n"), F.min("rid").alias("src_rid"), *(F.min_by(n, "rid").alias(f"src_{n}") for n in names)]


def _claims(keep: Scratch, rows: DataFrame, window: int, gram: int, bits: int, piece: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Passes 1 to 4: the affected texts (rid, text), the runs that are claimed to be equal, the contexts that were open, and what repeats within a text."""
    block = BLOCK if window == WINDOW else max(1, int((window - gram + 1) ** 0.5) + 4)
    # 1. Anchors whose gram occurs twice. If all of a gram's contexts go by one hash, no other anchor is to be compared with them.
    found = rows.where(F.octet_length("text") >= window).mapInArrow(_anchor_rows(window, gram, bits, piece), "gram long, around long, rid long, at long, stop long")
    grams = found.where("stop is null").groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1")
    grams = keep(grams.select("gram", (F.col("a") == F.col("b")).alias("alone")), "grams")
    anchors_ = keep(found.join(grams, "gram", "left").where("alone is not null or stop is not null"), "anchors")
    settled = keep(anchors_.where("stop is not null").select("rid", F.col("at").alias("start"), "stop"), "settled")
    shared = anchors_.where("stop is null").drop("stop")
    # 2. Contexts that occur twice, among others of the same gram.
    contexts = keep(shared.groupBy("gram", "around").agg(*_first("at")).where("n > 1").drop("n"), "contexts")
    mixed = shared.join(contexts, ["gram", "around"], "left")
    source = (F.col("src_rid") == F.col("rid")) & (F.col("src_at") == F.col("at"))
    flags = F.when(F.col("src_rid").isNull(), 0).when(source, SETTLED | SOURCE).otherwise(SETTLED)
    marked = mixed.where(~(F.col("alone") & source)).select("rid", F.struct((F.col("at") * 4 + flags).alias("anchor"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("src_rid", "src_at"))).alias("anchor"))
    marked = marked.groupBy("rid").agg(F.collect_set("anchor").alias("anchors"))
    # Texts that only stand for others or repeat only themselves have no anchor of their own here, but their bytes are needed.
    only = contexts.select(F.col("src_rid").alias("rid")).union(settled.select("rid")).distinct()
    lists = marked.join(only, "rid", "full_outer").select("rid", F.coalesce("anchors", F.array().cast(dict(marked.dtypes)["anchors"])).alias("anchors"))
    affected = keep.by(rows.join(lists.hint("shuffle_hash"), "rid").select("rid", "text", "anchors"), "affected", "rid")
    release(grams, anchors_, contexts)
    judged = keep(affected.where(F.size("anchors") > 0).mapInArrow(_context_rows(window, gram, bits, piece), CONTEXTS), "judged")
    by_context = judged.where("context is null").select("rid", F.col("at").alias("start"), "stop", "src_rid", F.col("src_at").alias("src_start"))
    still = judged.where("context is not null").drop("stop", "src_rid", "src_at")
    # 3. Blocks whose common bytes occur twice; if all their bytes do, that settles them.
    blocks = still.mapInArrow(_block_rows(window, gram, block, bits), "rid long, at long, block int, common long, whole long, span long")
    common = blocks.groupBy("common").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1")
    common = keep(common.select("common", (F.col("a") == F.col("b")).alias("alone")), "common")
    blocks = keep(blocks.join(common, "common"), "blocks")
    whole = keep(blocks.groupBy("common", "whole").agg(*_first("at")).where("n > 1").drop("n"), "whole")
    mixed = keep(blocks.join(whole, ["common", "whole"], "left").drop("common", "whole"), "mixed")
    release(common, blocks, whole)
    start, stop = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    by_block = mixed.where(F.col("src_rid").isNotNull() & ~source & (start + window <= stop)).select("rid", start.alias("start"), stop.alias("stop"), "src_rid", (F.col("src_at") + start - F.col("at")).alias("src_start"))
    # 4. Single windows of the blocks that are open or stand for settled ones.
    opened = mixed.where(F.col("src_rid").isNull() | (source & ~F.col("alone"))).groupBy("rid", "at").agg(F.collect_set("block").alias("blocks"))
    windows = still.join(opened, ["rid", "at"]).mapInArrow(_window_rows(window, gram, block, bits), "rid long, key long, place long")
    windows = keep(windows.select("rid", "key", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("more"), F.shiftright("place", 32).alias("start")), "windows")
    equal = keep(windows.groupBy("key", "more").agg(*_first("start")).where("n > 1").drop("n"), "equal")
    own = (F.col("src_rid") == F.col("rid")) & (F.col("src_start") == F.col("start"))
    by_window = windows.join(equal, ["key", "more"]).where(~own).select("rid", "start", (F.col("start") + window).alias("stop"), "src_rid", "src_start")
    claims = by_context.union(by_block).union(by_window).groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "src_rid", "src_start")).alias("claims"))
    runs = keep(claims.mapInArrow(_runs, "rid long, start long, stop long, src_rid long, src_start long"), "runs")
    release(mixed, windows, equal)
    return affected.select("rid", "text"), runs, still, settled


def repeated_spans(keep: Scratch, rows: DataFrame, window: int, gram: int, bits: int = BITS, piece: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """The affected texts (rid, text) of ``rows`` (rid, a key; text, binary), and their spans (rid, spans)."""
    if not 8 <= gram < window <= 2**15:
        raise ValueError("gram must be at least 8 and smaller than window")
    affected, runs, still, settled = _claims(keep, rows, window, gram, bits, piece)
    # 5. The bytes of each run beside those of its counterpart.
    key = ["src_rid", "src_start", "size"]
    runs = runs.withColumn("size", F.col("stop") - F.col("start"))
    shares = keep(runs.groupBy(*key).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "shares")
    many = F.pmod(F.xxhash64("rid", "start"), F.col("shares")).cast("int")
    salted = runs.join(shares.where("shares > 1"), key, "left").select("rid", F.struct("start", "size", "src_rid", "src_start", F.coalesce(many, F.lit(0)).alias("salt"), F.lit(None).cast("int").alias("shares")).alias("w"))
    none = F.lit(None)
    parts = shares.select(F.col("src_rid").alias("rid"), F.struct(F.col("src_start").alias("start"), "size", none.cast("long").alias("src_rid"), none.cast("long").alias("src_start"), none.cast("int").alias("salt"), "shares").alias("w"))
    wanted = salted.union(parts).groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    slices = affected.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted").mapInArrow(_slices, SLICE)
    side = slices.repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.col("rid").asc_nulls_first())
    judged = keep(side.mapInArrow(_compared, "rid long, start long, stop long, same boolean"), "compared")
    spans = judged.where("same").union(settled.withColumn("same", F.lit(True))).select("rid", _span(F.col("start"), F.col("stop")).alias("span"))
    if judged.where("not same").limit(1).count():  # hashes met by chance: all that this can touch, by its bytes
        open_spans = still.where("high >= low").select("rid", _span(F.col("at") + F.col("low"), F.col("at") + F.col("high") + window).alias("span"))
        touched = judged.where("not same").select("rid", _span(F.col("start"), F.col("stop")).alias("span")).union(open_spans)
        touched = affected.join(touched.groupBy("rid").agg(F.collect_set("span").alias("spans")), "rid")
        windows = keep(touched.mapInArrow(_whole_windows(window), "rid long, start long, bytes binary"), "whole-windows")
        twice = windows.groupBy("bytes").count().where("count > 1").select("bytes")
        spans = spans.union(windows.join(twice, "bytes", "left_semi").select("rid", _span(F.col("start"), F.col("start") + window).alias("span")))
    return affected, spans.groupBy("rid").agg(F.collect_set("span").alias("spans"))


def _cleaned(rows: DataFrame, window: int, gram: int, bits: int, piece: int, with_text: bool) -> DataFrame:
    """(__key, n_removed, n_spans, kept) of each changed row; ``kept`` is what is left of the text, or the SHA-256 of that."""
    with Scratch() as keep:
        affected, spans = repeated_spans(keep, rows, window, gram, bits, piece)
        cut = affected.join(spans.hint("shuffle_hash"), "rid").select("rid", "text", "spans").mapInArrow(_removed(with_text), "rid long, n_removed long, n_spans long, kept binary")
        return materialise(cut, "changed").withColumnRenamed("rid", "__key")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = BITS, piece: int = BUFFER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that lies in a string of ``window`` bytes which also starts
    anywhere else, in its own text or another, is removed; strings are judged
    on the input and never go from one text into the next. Null text counts as
    empty. Rows that repeat an id, or have none, are texts of their own: if the
    text repeats too, the rows repeat each other. Texts are taken whole; a long
    one is worked on in pieces. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "doc_id", "rid")
    changed = _cleaned(rows.select("rid", "text"), window, gram, bits, piece, False)
    sizes = rows.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("own"))
    joined = sizes.join(changed, F.col("rid") == F.col("__key"), "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.lower(F.hex(F.coalesce("kept", "own"))).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes gone from the texts, all columns in place.

    A removed run shrinks to whole characters, so nothing stands in a text that
    was not in it. Null texts stay null; rows that repeat an id, or have none,
    are told apart; an empty table gives an empty result.
    """
    rid, key, kept = unused(docs, "__rid", "__key", "__kept")
    rows = keyed(docs, id_col, rid)
    changed = _cleaned(rows.select(F.col(rid).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), window, gram, BITS, BUFFER, True).select(F.col("__key").alias(key), F.col("kept").cast("string").alias(kept))
    joined = rows.join(changed, F.col(rid) == F.col(key), "left")
    return joined.select(*[F.coalesce(kept, F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
