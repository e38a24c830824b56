"""Bounded samples of labelled documents, for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import materialise

#: Candidates for the sample that are expected to meet in one task, as a multiple of it.
FOUND = 4


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: tuple[int, int], per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` documents of each label 0 and 1.

    ``held_out`` is (parts, part): labels of rows with that remainder are never
    read. Documents are drawn by a hash of their id, so the draw is the same
    for the same labels. An id with several labels has their majority, 1 if
    even. Null ids and null labels give no example.
    """
    parts, part = held_out
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.where(remainder("doc_id", parts) != part).groupBy("doc_id").agg(F.avg("y").alias("y")).withColumn("y", (F.col("y") >= 0.5).cast("int"))
    known = materialise(known, "known")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = None
    for y in (0, 1):
        # Hashes are even, so those under this bound are about FOUND times the sample, however many labels there are.
        small = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < F.lit(FOUND * per_class / sizes.get(y, 1))
        own = known.where((F.col("y") == y) & small).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = own if drawn is None else drawn.union(own)
    drawn = F.broadcast(materialise(drawn, "sample"))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(drawn, "doc_id")
