"""Upkeep of a table of one row per key without rewriting it for every batch.

The table is a base and deltas. A batch becomes a delta, as large as the batch
and no larger; reading merges base and deltas by the rule that keeps one row
per key, which gives the same in any order and grouping. The base lies in
ranges of the hashed key, so no day and no city makes a range large. Compaction
merges the deltas into the ranges that they touch and leaves the other ranges
alone. Every step ends with one manifest (``sources.versions``): a job that is
lost before changed nothing, and a batch that comes again is known by its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirmark.functions.names import free_names
from weirmark.plans.facts import PRICE_KEY, hourly_prices
from weirmark.sources.versions import Store


class MergedTable:
    """``keep`` gives one row per key of any rows, and is the same for all of them at once or step by step.

    Rows that ``keep`` compares share the values of ``keys``. ``ranges`` is
    fixed with the first batch; a range should hold some hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = tuple(PRICE_KEY), keep: Callable[[DataFrame], DataFrame] = hourly_prices, ranges: int = 64):
        self.store, self.schema, self.keys, self.keep, self.ranges = Store(spark, path), schema, list(keys), keep, ranges

    def _state(self) -> tuple[int, dict]:
        number, state = self.store.current()
        return number, state or {"ranges": self.ranges, "base": {}, "deltas": [], "writers": {}}

    def _read(self, folders: list[str]) -> DataFrame | None:
        paths = [f"{self.store.path}/{x}" for x in folders]
        return self.store.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _merged(self, base: list[str], deltas: list[str]) -> DataFrame:
        found = self._read([*base, *deltas])
        return self.keep(found) if found is not None else self.store.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the last commit; what is committed later, or compacted, doesn't change it."""
        _, state = self._state()
        if not state["deltas"]:  # the base has one row per key as it is
            base = self._read(list(state["base"].values()))
            return base if base is not None else self.store.spark.createDataFrame([], self.schema)
        return self._merged(list(state["base"].values()), [f for x in state["deltas"] for f in x["ranges"].values()])

    def upsert(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Adds a batch; False if the writer has added this one or a later one before, whether or not it has been compacted since."""
        number, state = self._state()
        if batch <= state["writers"].get(writer, -1):
            return False
        (part,) = free_names(rows, "range")
        folder = self.store.new_folder("delta")
        kept = self.keep(rows.select(*self.schema.names)).withColumn(part, self._range(state))
        kept.write.partitionBy(part).parquet(f"{self.store.path}/{folder}")
        state["deltas"].append({"ranges": self._parts(folder)})
        state["writers"][writer] = batch
        self.store.commit(number, state)
        return True

    def compact(self) -> list[int]:
        """Merges all deltas into the ranges of the base that they touch; returns these."""
        number, state = self._state()
        touched = sorted({int(r) for x in state["deltas"] for r in x["ranges"]})
        if touched:
            (part,) = free_names(self.store.spark.createDataFrame([], self.schema), "range")
            folder = self.store.new_folder("base")
            base = [x for r, x in state["base"].items() if int(r) in touched]
            merged = self._merged(base, [f for x in state["deltas"] for f in x["ranges"].values()])
            merged.withColumn(part, self._range(state)).write.partitionBy(part).parquet(f"{self.store.path}/{folder}")
            state["base"] |= self._parts(folder)
            state["deltas"] = []
            self.store.commit(number, state)
        return touched

    def _range(self, state: dict):
        return F.pmod(F.xxhash64(*self.keys), F.lit(state["ranges"])).cast("int")

    def _parts(self, folder: str) -> dict[str, str]:
        """The ranges that a delta has rows of, each with its folder."""
        at, fs = self.store._at(folder)
        names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
        return {x.rpartition("=")[2]: f"{folder}/{x}" for x in names}


def maintain(stream: DataFrame, table: MergedTable, checkpoint: str, name: str, compact_at: int = 16) -> StreamingQuery:
    """Adds what the stream has as deltas, and compacts when there are ``compact_at`` of them.

    ``name`` and the number of the micro-batch are the batch's id, so one that
    is run again after a failure is added once.
    """

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(batch, name, number)
        if len(table.store.current()[1]["deltas"]) >= compact_at:
            table.compact()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
