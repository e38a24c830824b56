"""Reading large JSON documents by several tasks.

A document is one object in a file: some fields, and arrays whose elements are
records. Where a record begins depends on all that stands before it, so a file
is usually one task. Here Spark's text reader deals it out by byte ranges, cut
at closing braces, and it is read twice:

1. Of each range: how many quotes are open, and which brackets it closes and
   leaves open, if it begins outside a string and if it begins inside one. From
   these few values, range after range, follows the state in which each begins.
2. Knowing that, a task cuts its range into whole records. Only what the ends
   of a range cut through is brought together, in the order of the ranges.

No task holds a document, and no text is shuffled but that at the ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.sources.scratch import scratch_folder

CORRUPT = "_corrupt_record"
SUMS = "file string, block long, turns int, shut0 int, open0 string, shut1 int, open1 string, size long"
STATES = "f string, b long, inside int, stack string, short boolean"
PIECES = "file string, block long, place long, kind string, arrays int, text string"
#: Bytes that are looked at together.
BUFFER = 1 << 20
_DOWN = np.zeros(256, np.int64)
_DOWN[[ord("{"), ord("[")]] = 1
_DOWN[[ord("}"), ord("]")]] = -1


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes stand that no backslash takes away; ``data`` does not begin behind a backslash."""
    at = np.flatnonzero(data == ord('"'))
    if not len(at):
        return at
    solid = np.where(data != ord("\\"), np.arange(len(data)), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(solid)))[at]  # the last that is no backslash
    return at[(at - 1 - before) % 2 == 0]


def _inside(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Which bytes stand in a string, and whether what follows does."""
    turns = np.zeros(len(data), np.int8)
    turns[_quotes(data)] = 1
    found = (np.cumsum(turns) + inside) % 2
    return found == 1, int(found[-1]) if len(data) else inside


def _brackets(data: np.ndarray, inside: np.ndarray) -> tuple[int, str]:
    """How many brackets from before are shut, and those that stay open."""
    at = np.flatnonzero(_DOWN[data] * ~inside)
    depth = np.cumsum(_DOWN[data[at]])
    if not len(at):
        return 0, ""
    shut = max(0, -int(depth.min()))
    # A level's last bracket is the one that stays open.
    opened = [at[np.flatnonzero((depth == level) & (_DOWN[data[at]] == 1))[-1]] for level in range(1 - shut, int(depth[-1]) + 1)]
    return shut, "".join(chr(data[i]) for i in opened)


def _after(stack: str, shut: int, opened: str) -> tuple[int, str]:
    """Brackets that are shut and open after more of them; ``shut`` may go beyond the stack."""
    return max(0, shut - len(stack)), stack[: max(0, len(stack) - shut)] + opened


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bytes]]:
    """Some fragments of a range at a time, the brace behind each of them in place."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        codes = files.dictionary_encode().indices.to_numpy()
        sizes = np.array([len(x.as_buffer()) for x in batch.column("value")], np.int64)
        part = np.cumsum(sizes) // BUFFER
        at = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows], strict=True):
            own = batch.slice(a, b - a)
            yield files[a].as_py(), int(blocks[a]), own, b"".join(x.as_py() + b"}" for x in own.column("value"))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to strings and brackets, for either beginning."""
    key, turns, size, ends = None, 0, 0, [(0, ""), (0, "")]

    def row() -> pa.RecordBatch:
        values = (*key, turns, *ends[0], *ends[1], size)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=_names(SUMS))

    for file, block, _, text in _buffers(batches):
        if (file, block) != key:
            if key:
                yield row()
            key, turns, size, ends = (file, block), 0, 0, [(0, ""), (0, "")]
        data = np.frombuffer(text, np.uint8)
        inside, last = _inside(data, 0)
        both = (_brackets(data, inside), _brackets(data, ~inside))
        for begin in (0, 1):
            shut, opened = both[(turns + begin) % 2]
            more, stack = _after(ends[begin][1], shut, opened)
            ends[begin] = (ends[begin][0] + more, stack)
        turns, size = (turns + last) % 2, size + len(data)
    if key:
        yield row()


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each range begins; ranges come in order, a file's together."""
    file, inside, stack, total, held = None, 0, "", 0, None

    def row(short: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((*held, short), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=_names(STATES))

    for batch in batches:
        for r in batch.to_pylist():
            if held:
                yield row(r["file"] != file and total > length)
            if r["file"] != file:
                file, inside, stack, total = r["file"], 0, "", 0
            held, length = (file, r["block"], inside, stack), r["file_size"]
            _, stack = _after(stack, r[f"shut{inside}"], r[f"open{inside}"])
            inside, total = (inside + r["turns"]) % 2, total + r["size"]
    if held:
        yield row(total > length)


class _Cutter:
    """Cuts what comes of a range into records, the parts of records at its ends, and the frame around them."""

    def __init__(self, inside: int, stack: str):
        self.inside, self.depth, self.arrays = inside, len(stack), 0
        self.listed = stack[1:2] == "["  # whether what is open below the document is an array
        self.kind = "rest" if self.listed and stack[2:3] == "{" else "frame"
        self.fresh = self.listed and len(stack) == 2 and not inside  # a record has ended just before
        self.held: list[bytes] = []

    def cut(self, text: bytes) -> Iterator[tuple[str, int, bytes]]:
        data = np.frombuffer(text, np.uint8)
        inside, self.inside = _inside(data, self.inside)
        down = _DOWN[data] * ~inside
        depth = self.depth + np.cumsum(down)
        marks = np.flatnonzero(((down == 1) & (depth == 2)) | ((down == 1) & (depth == 3) & (data == ord("{"))) | ((down == -1) & (depth == 2) & (data == ord("}"))))
        at = 0
        for i in marks.tolist():
            if down[i] == 1 and depth[i] == 2:
                self.listed = data[i] == ord("[")
                self.arrays += int(self.listed)
            elif down[i] == 1:
                if self.listed:
                    yield from self._close(text[at:i], "frame")
                    at, self.kind = i, "record"
            elif self.kind != "frame":
                yield from self._close(text[at : i + 1], self.kind)
                at, self.kind, self.fresh = i + 1, "frame", True
        self.held.append(text[at:])
        self.depth = int(depth[-1]) if len(data) else self.depth

    def _close(self, text: bytes, kind: str) -> Iterator[tuple[str, int, bytes]]:
        whole = b"".join((*self.held, text))
        self.held = []
        if kind == "frame" and self.fresh:  # the comma behind a record goes with it
            whole = whole.lstrip(b" \t\r\n,")
        if whole or kind != "frame":
            yield kind, self.arrays, whole

    def rest(self) -> Iterator[tuple[str, int, bytes]]:
        """What the end of the range cuts through: the begin of a record, or one that goes on all through it."""
        yield from self._close(b"", {"record": "first", "rest": "through", "frame": "frame"}[self.kind])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, cutter, short, last, place = None, None, False, b"", 0

    def rows(made: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        n = len(made)
        columns = [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2].decode(errors="replace") for m in made])]
        return pa.RecordBatch.from_arrays(columns, names=_names(PIECES))

    def finish() -> pa.RecordBatch:
        # The text behind a file's last brace has no brace of its own.
        made = [*cutter.cut(last[:-1] if short else last), *cutter.rest()]
        return rows([*made, ("arrays", cutter.arrays, b"")])

    for file, block, own, text in _buffers(batches):
        if (file, block) != key:
            if key:
                yield finish()
            key, place, last = (file, block), 0, b""
            cutter, short = _Cutter(own.column("inside")[0].as_py(), own.column("stack")[0].as_py()), own.column("short")[0].as_py()
        made, last = list(cutter.cut(last)), text  # one behind, as the file's last brace is known at the end
        if made:
            yield rows(made)
            place += len(made)
    if key:
        yield finish()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, frame, whole, names): whether the frame is a JSON object, and the names of its arrays in order."""
    for batch in batches:
        whole, names = [], []
        for text in batch.column("frame").to_pylist():
            try:
                found = json.loads(text)
            except ValueError:
                found = None
            whole.append(isinstance(found, dict))
            names.append([k for k, v in found.items() if isinstance(v, list)] if whole[-1] else [])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("frame"), pa.array(whole, pa.bool_()), pa.array(names, pa.list_(pa.string()))], names=["file", "frame", "whole", "names"])


def split_documents(spark: SparkSession, path: str, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents as (file, frame, whole, names) and their records as (file, array, record), JSON texts both.

    The frame is the document without its records; ``whole`` is false if that
    is no JSON object. A record is an object that is an element of one of the
    document's own arrays, and ``array`` names it. Such an array holds objects
    or none. A record and a frame fit a row. Records are kept in the folder
    ``scratch``.
    """
    text = spark.read.option("lineSep", "}").text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    parts = text.select(F.col("value").cast("binary").alias("value"), *meta)
    files = text.select(meta[0], F.col("_metadata.file_size").alias("file_size")).distinct()
    sums = parts.mapInArrow(_sum_up, SUMS).join(files, "file")
    states = sums.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_follow, STATES)
    # A row per range, as the driver holds one to plan the scan; broadcast, so that a range stays in order.
    placed = parts.join(F.broadcast(states), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    scratch = scratch or scratch_folder(spark, "documents")
    placed.mapInArrow(_cut, PIECES).write.partitionBy("kind").parquet(scratch)
    pieces = spark.read.schema(T.StructType.fromDDL(PIECES)).parquet(scratch)
    in_order = F.array_sort(F.collect_list(F.struct("block", "place", "text", "arrays")))
    whole = F.array_join(F.col("p.text"), "")
    frames = pieces.where("kind = 'frame'").groupBy("file").agg(in_order.alias("p")).select("file", whole.alias("frame"))
    frames = frames.mapInArrow(_named, "file string, frame string, whole boolean, names array<string>")
    # Records that the ends of ranges cut through: what follows a first part, up to the next.
    number = F.sum(F.when(F.col("kind") == "first", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "place"))
    cut = pieces.where("kind in ('first', 'through', 'rest')").withColumn("number", number).groupBy("file", "number").agg(in_order.alias("p"))
    cut = cut.select("file", F.get("p.block", F.lit(0)).alias("block"), F.get("p.arrays", F.lit(0)).alias("arrays"), whole.alias("record"))
    # Arrays are counted within a range; those of the ranges before come on top, a row per range again.
    before = F.sum("arrays").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.where("kind = 'arrays'").select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("earlier"))
    records = pieces.where("kind = 'record'").select("file", "block", "arrays", F.col("text").alias("record")).union(cut)
    records = records.join(F.broadcast(offsets), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    names = frames.select("file", "names")
    return frames, records.join(names, "file").select("file", F.get("names", F.col("arrays") + F.col("earlier") - 1).alias("array"), "record")


def read_records(spark: SparkSession, path: str, schema: str, array: str, scratch: str | None = None) -> DataFrame:
    """Documents with the columns of ``schema``, a row for each record of ``array``, which is then an array of one.

    A document without records is a row with what the array is there: empty, or
    null if it is absent. A file that is no JSON object is a row of nulls with
    its name in ``_corrupt_record``; a record that does not fit the schema is a
    row of nulls but for the document's fields, with its text there. So what
    reads the rows of the ``multiLine`` reader reads these, whatever the size
    of a document.
    """
    declared = T.StructType.fromDDL(schema)
    element = declared[array].dataType.elementType
    frames, records = split_documents(spark, path, scratch)
    docs = frames.select("file", F.when(F.col("whole"), F.from_json("frame", declared)).alias("d"))
    # A null of the text itself would be indistinguishable from a bad record, so the text decides.
    marked = T.StructType([*element.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = records.where(F.col("array") == array).select("file", F.from_json("record", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    one = F.array(F.struct(*(F.col("r")[f.name].alias(f.name) for f in element.fields)))
    with_records = parsed.join(docs, "file").select(*(one.alias(c) if c == array else F.col("d")[c].alias(c) for c in declared.names), F.col("r")[CORRUPT].alias(CORRUPT))
    without = docs.join(parsed.select("file").distinct(), "file", "left_anti")
    without = without.select(*(F.col("d")[c].alias(c) for c in declared.names), F.when(F.col("d").isNull(), F.col("file")).alias(CORRUPT))
    return with_records.unionByName(without)
