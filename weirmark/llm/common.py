"""Small helpers shared by the document operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of any of them."""
    taken = {c.lower() for c in df.columns}
    end = ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster a machine-local folder would not be seen by the others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/weirmark-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never the jobs before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.__dict__["scratch"] = path
    return found


def keyed(docs: DataFrame, id_col: str, rid: str) -> DataFrame:
    """``docs`` with a column ``rid`` that tells every row apart: its id, or a row number if ids are null or repeat.

    Row numbers are written with the rows, so they stay what they are.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("i")).count()
    if ids.where("i is null or count > 1").limit(1).count() == 0:
        return docs.withColumn(rid, F.col(id_col).cast("long"))
    return materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        if name := df.__dict__.pop("catalogued", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path := df.__dict__.pop("scratch", None):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Materialised tables of one operator; what it has not released before is gone when it ends, however it ends."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        release(*self.made)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(materialise(df, name))
        return self.made[-1]

    def own(self, df: DataFrame) -> DataFrame:
        """``df``, a materialised table that another function has made, goes with the others."""
        self.made.append(df)
        return df

    def by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Written as a table bucketed by ``key`` in the shared folder, so that joins on it need no shuffle."""
        spark = df.sparkSession
        path, made = scratch_path(spark, name), f"weirmark_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(made)
        found = spark.table(made)
        found.__dict__ |= {"scratch": path, "catalogued": made}
        self.made.append(found)
        return found


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by ``keys``.

    A table has ``rows`` rows, or up to a batch and a group more, so what a
    task holds depends on its largest group and not on its partition.
    """
    held, n, start, last = [], 0, 0, None  # start: the row of those held where the last group begins
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = int(np.logical_and.reduce([c == c[-1] for c in columns]).sum())
        end = tuple(c[-1] for c in columns)
        if same < batch.num_rows or end != last:
            start = n + batch.num_rows - same
        last = end
        held.append(batch)
        n += batch.num_rows
        if n >= rows and start:
            table = pa.Table.from_batches(held)
            yield table.slice(0, start)
            held, n, start = table.slice(start).to_batches(), n - start, 0
    if held:
        yield pa.Table.from_batches(held)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(made))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
