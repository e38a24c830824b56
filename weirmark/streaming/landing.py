"""The append-only raw zone, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirmark.functions.scalars import iso_timestamp

LAYOUT = ["source", "ingest_date"]


def envelope(body: DataFrame, meta: dict[str, Column], payload: str) -> DataFrame:
    """(_meta, body): a record that describes itself; the body is kept as it is."""
    return body.select(F.struct(*(c.alias(n) for n, c in meta.items())).alias("_meta"), F.col(payload).alias("body"))


def verbatim(body: DataFrame, meta: dict[str, Column], payload: str) -> DataFrame:
    """(_meta, body, broken): the body as a variant, with every field that it has; a text that is no JSON as it is in ``broken``."""
    parsed = F.try_parse_json(payload)
    broken = F.when(parsed.isNull(), F.col(payload))
    return body.select(F.struct(*(c.alias(n) for n, c in meta.items())).alias("_meta"), parsed.alias("body"), broken.alias("broken"))


#: Kinds of a variant that a declared type takes; of the others any.
KINDS = {"string": {"STRING"}, "bigint": {"BIGINT"}, "boolean": {"BOOLEAN"}, "double": {"BIGINT", "DECIMAL", "DOUBLE"}}


def _unlike(found: T.DataType, declared: T.DataType | None, path: str) -> list[tuple[str, str, str]]:
    """(path, kind, problem) of what is found beyond or unlike the declared type."""
    kind = {"struct": "OBJECT", "null": "VOID", "void": "VOID"}.get(found.typeName(), found.simpleString().partition("(")[0].partition("<")[0].upper())
    if declared is None:
        return [(path, kind, "undeclared")]
    if kind == "VOID" or isinstance(declared, T.VariantType):
        return []
    if isinstance(declared, T.MapType) and kind == "OBJECT":
        return [x for f in found.fields for x in _unlike(f.dataType, declared.valueType, f"{path}.*")]
    if isinstance(declared, T.StructType) and kind == "OBJECT":
        known = {f.name: f.dataType for f in declared.fields}
        return [x for f in found.fields for x in _unlike(f.dataType, known.get(f.name), f"{path}.{f.name}")]
    if isinstance(declared, T.ArrayType) and kind == "ARRAY":
        return _unlike(found.elementType, declared.elementType, f"{path}[*]")
    return [] if kind in KINDS.get(declared.simpleString(), ()) else [(path, kind, "other type")]


def drift(records: DataFrame, declared: T.StructType, body: str = "body") -> DataFrame:
    """(source, ingest_date, path, kind, problem): fields of the bodies that are not declared, and those of another type.

    Types are merged in one aggregate, in each task before the shuffle; what
    comes to the driver is a type for each source and day. A field of several
    types is a VARIANT; of an undeclared object only the object is named.
    """
    spark = records.sparkSession
    merged = records.where(F.col(body).isNotNull()).groupBy(*LAYOUT).agg(F.schema_of_variant_agg(body).alias("type")).collect()
    rows = {(r["source"], r["ingest_date"], *x) for r in merged for x in _unlike(T.DataType.fromDDL(r["type"].replace("OBJECT<", "STRUCT<")), declared, "$")}
    return spark.createDataFrame(sorted(rows, key=str), "source string, ingest_date date, path string, kind string, problem string")


def landed(records: DataFrame) -> DataFrame:
    """Adds the partition columns; the day is the record's own UTC day, so a replay lands where the first run did."""
    return records.withColumn("source", F.col("_meta.source")).withColumn("ingest_date", iso_timestamp(F.col("_meta.fetched_at_utc")).cast("date"))


def append_batch(records: DataFrame, path: str) -> None:
    """Never rewrites. Rebalancing by source and day keeps files few, and AQE splits days that are large."""
    landed(records).hint("rebalance", *LAYOUT).write.mode("append").partitionBy(*LAYOUT).parquet(path)


def append_once(records: DataFrame, path: str, digest: str = "record_digest") -> None:
    """Appends the records that are not there yet, so that a batch may be landed again after a failure, or overlap another.

    A record is known by the digest of all that it holds, stored beside it;
    equal records land once. Only the digests of the batch's own sources and
    days are read, and of those Spark keeps what meets a Bloom filter of the
    batch where the join is large enough to need one.
    """
    spark, key = records.sparkSession, [*LAYOUT, digest]
    body = F.to_json(F.struct(*(F.col(c) for c in records.columns)), {"ignoreNullFields": "false"})
    fresh = landed(records).withColumn(digest, F.unhex(F.sha2(body, 256))).dropDuplicates(key)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        days = [r[0] for r in fresh.select("ingest_date").distinct().collect()]  # days of a calendar
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("ingest_date").isin([d for d in days if d]) | (F.col("ingest_date").isNull() if None in days else F.lit(False))).select(*key)
        asked = fresh.select(*key)
        same = [stored[c].eqNullSafe(asked[c]) for c in key]
        known = stored.join(asked, same, "left_semi")  # no more rows than the batch has
        fresh = fresh.join(known, [fresh[c].eqNullSafe(known[c]) for c in key], "left_anti")
    fresh.hint("rebalance", *LAYOUT).write.mode("append").partitionBy(*LAYOUT).parquet(path)


def append_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Lands what has not been landed, exactly once, and stops."""
    return landed(records).writeStream.format("parquet").outputMode("append").partitionBy(*LAYOUT).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
