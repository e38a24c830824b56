"""Token counts with a digest cache.

Counts are stored in a Parquet table by content digest, in a folder per tokenizer digest.
Documents' digests are joined with it; of the digests it lacks, one document
each is encoded and the new counts are appended. Copies are never encoded
twice, neither within a run nor across runs over one cache.

The text is shuffled once, by the unique pair of id and digest, so that copies
of one text do not meet in one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.llm.common import materialise, unused
from weirmark.llm.units import Units

CACHE = "content_digest binary, n_tokens long"
#: Bytes of text that are encoded at once; bounds what the encodings take in memory.
BATCH_BYTES = 1 << 18
#: Bytes of text whose equal pieces are encoded once.
BLOCK_BYTES = 8 << 20

_loaded: dict[str, object] = {}


def tokenizer_digest(model: bytes) -> str:
    """Digest of the tokenizer's file and of the version of the library that runs it."""
    import tokenizers

    return hashlib.sha256(model + tokenizers.__version__.encode()).hexdigest()


def _encoder(shared, digest: str):
    if digest not in _loaded:
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[digest] = Tokenizer.from_str(shared.value.decode())
    return _loaded[digest]


def _cuts_at_spaces(model: bytes) -> bool:
    """Whether the tokenizer is byte-level BPE, which never joins what stands on two sides of a space."""
    parts = json.loads(model)
    before = parts.get("pre_tokenizer") or {}
    return not parts.get("normalizer") and not parts.get("truncation") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    made, a, size = [], 0, 0
    for b, text in enumerate(texts, 1):
        size += len(text)
        if size >= BATCH_BYTES or b == len(texts):
            made += [len(x) for x in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
            a, size = b, 0
    return made


def _count(shared, digest: str, at_spaces: bool):
    """Counts of each text; equal pieces of a block are encoded once where the tokenizer allows it."""

    def block(tokenizer, special: list[str], keys: list, texts: list[str]) -> pa.RecordBatch:
        units, whole = Units(), []
        cuts: list[np.ndarray | None] = []
        for i, text in enumerate(texts):
            cuts.append(units.cut(text) if at_spaces and not any(x in text for x in special) else None)
            if cuts[-1] is None:
                whole.append(i)
        sizes = np.array(_lengths(tokenizer, units.texts), np.int64)
        alone = dict(zip(whole, _lengths(tokenizer, [texts[i] for i in whole]), strict=True))
        counts = [alone[i] if cut is None else int(sizes[cut].sum()) for i, cut in enumerate(cuts)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tokenizer = _encoder(shared, digest)
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("content_digest"), batch.column("text"), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block(tokenizer, special, keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield block(tokenizer, special, keys, texts)

    return run


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; null counts as empty. Any other change could change the count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(content_digest, n_tokens) stored for a tokenizer; empty if nothing is. The cache has a folder per tokenizer, so no other is read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/tokenizer_digest={version}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder.toString())


def _counted(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content_digest, n_bytes) of every row, and (content_digest, n_tokens) of every digest among them, once each."""
    spark = docs.sparkSession
    model = open(tokenizer_path, "rb").read()
    version = tokenizer_digest(model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), content_digest(F.col(text_col)).alias("content_digest"))
    ids = materialise(rows.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    distinct = ids.groupBy("content_digest").agg(F.min("doc_id").alias("first_id"))
    misses = distinct.join(read_cache(spark, cache_path, version), "content_digest", "left_anti").select(F.col("content_digest").alias("missed"), "first_id")
    shared = spark.sparkContext.broadcast(model)  # one tokenizer file, a few MB
    to_encode = rows.join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content_digest") == F.col("missed"))).select("content_digest", "text")
    if ids.groupBy("doc_id", "content_digest").count().where("count > 1").limit(1).count():
        to_encode = to_encode.dropDuplicates(["content_digest"])  # rows that repeat id and text
    to_encode.mapInArrow(_count(shared, version, _cuts_at_spaces(model)), CACHE).write.mode("append").parquet(f"{cache_path}/tokenizer_digest={version}")

    # Only the digests of this run, before equal entries of the cache are merged.
    asked = ids.select("content_digest").distinct()
    counts = read_cache(spark, cache_path, version).join(asked, "content_digest", "left_semi").groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return ids, materialise(counts, "counts")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens.

    ``n_tokens`` is what the tokenizers library gives for the whole text,
    however long, without added special tokens. ``cache_path`` is a folder of
    the shared store; it is read first and what it lacks is appended. Two runs
    that append at once may both store a digest; reading takes one of the equal
    counts. Null text counts as empty; null and repeated ids are rows like
    others; an empty table gives an empty result; other columns are ignored.
    """
    ids, counts = _counted(docs, tokenizer_path, cache_path, id_col, text_col)
    return ids.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")


def with_token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with its columns as they are and the token count of each row's text as ``out``; cases as in ``token_counts``."""
    _, counts = _counted(docs, tokenizer_path, cache_path, id_col, text_col)
    digest, own = unused(docs, "__digest", "__own")
    counts = counts.select(F.col("content_digest").alias(own), F.col("n_tokens").alias(out))
    joined = docs.withColumn(digest, content_digest(F.col(text_col))).join(counts.hint("shuffle_hash"), F.col(digest) == F.col(own))
    return joined.select(*docs.columns, out)
