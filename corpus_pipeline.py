"""A training corpus made from ``documents`` in five stages, each on all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's ``docs``. All stages but
the last return the columns of ``documents``, whatever columns came with them;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.llm.common import scratch_path, table
from weirmark.llm.exact_dedup import drop_exact_duplicates
from weirmark.llm.packing import pack
from weirmark.llm.queries import tokenizer_file
from weirmark.llm.similar import drop_similar
from weirmark.llm.suffix_dedup import remove_repeats
from weirmark.llm.token_counts import with_token_counts
from weirmark.llm.toxicity import drop_toxic

#: Vocabulary file of the tokens that batches are packed by.
TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; all others stay, null and empty texts among them."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z, the row with the smallest doc_id stays.

    A null text equals an empty one; a null id counts as larger than any other; of rows equal in both one stays.
    """
    return drop_exact_duplicates(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word Jaccard similarity 0.8 or more join, the one with the smallest doc_id stays.

    Null and wordless texts link with each other; rows that share an id are told apart.
    """
    return drop_similar(docs, words=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters in strings of 200 bytes that also start elsewhere go; ``n_chars`` is what is left.

    A document may end up empty; it stays. Null texts stay null, and keep their ``n_chars``.
    """
    cleaned = remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned texts in batches of documents of like length, by the tokens of ``TOKENIZER``.

    Returns doc_id, n_tokens, bucket, boundary, batch_id, slot, padding and text.
    """
    counted = with_token_counts(docs.select("doc_id", "text"), tokenizer_file(TOKENIZER), scratch_path(spark, "token-cache"))
    return pack(counted, buckets=16, token_budget=16384, keep=("text",))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Stages 1 to 4 are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
