"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.llm.best_fit import best_fit_pack
from weirmark.llm.bit_planes import bit_plane_clusters
from weirmark.llm.bpe import bpe_round_trip
from weirmark.llm.common import scratch_path, table
from weirmark.llm.exact_dedup import exact_dedup
from weirmark.llm.knn_join import top_k
from weirmark.llm.language_id import identify_language
from weirmark.llm.packing import pack, word_count
from weirmark.llm.prefix_trie import prefix_trie
from weirmark.llm.quality import classify_quality
from weirmark.llm.simhash import simhash_components
from weirmark.llm.suffix_dedup import suffix_dedup
from weirmark.llm.token_counts import token_counts
from weirmark.llm.toxicity import classify_toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"), held_out=(4, 2))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each run, so that a run's counts are all made by it.
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), buckets=16, token_budget=16384)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=(3, 1))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words_in_shingle=3, max_bits=2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=(5, 0))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), size=1024, end=2)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), group=5, most=9)


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_plane_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024.0, seed="3")


def lloyd_sql(k: int, rounds: int, scale: float, seed: str) -> str:
    """Clusters by rounds of one query each; sums are integers, so nothing depends on their order."""
    steps = [f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS INTEGER) AS c, x
            FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})
        )"""]
    assign = """(SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS cluster, min(d) AS distance
            FROM (SELECT v.rid, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {now} c) GROUP BY rid)"""
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED {assign.format(now=f"c{r}")}, s{r} AS MATERIALIZED (
            SELECT cluster, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n
            FROM (SELECT a.cluster, unnest(v.x) AS x, unnest(range(64)) AS i FROM v JOIN a{r} a USING (rid)) GROUP BY cluster, i
        ), c{r + 1} AS MATERIALIZED (
            SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cluster) m ON m.cluster = c.c
        )""")
    return "WITH " + ", ".join(steps) + f""", l AS {assign.format(now=f"c{rounds}")}
        SELECT v.vec_id, l.cluster, l.distance, CAST(sum(l.distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(l.distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM v JOIN l USING (rid) JOIN c{rounds} c ON c.c = l.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_exact_topk, op4_token_counts, op5_packing, op6_quality, op7_simhash, op8_exact_dedup, op9_toxicity, op10_bpe, op11_best_fit, op12_prefix_trie, op13_bit_planes)}

ORACLES: dict[str, str] = {
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), n AS (
            SELECT c, count(*) AS n, c - c % 5 AS b, CAST(c AS VARCHAR) AS s FROM t GROUP BY c
        ), crc AS (
            SELECT c, n, b, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(8 * length(s))), lambda x, i: xor(
                xor(x, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1,
                3988292384 * (xor(x, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1)))) % 9 AS h
            FROM n
        ), v AS (
            SELECT a.c, a.b, a.h, least(a.h, coalesce(b.n, 0)) AS taken, least(a.h, coalesce(b.n, 0)) + greatest(a.n - a.h, 0) AS len FROM crc a LEFT JOIN n b ON b.c = a.b
        ), r AS MATERIALIZED (
            SELECT v.c, v.len, t.p - v.h + v.taken + 1 AS d, t.role, t.text FROM v JOIN t ON t.c = v.c AND t.p >= v.h
            UNION ALL SELECT v.c, v.len, t.p + 1, t.role, t.text FROM v JOIN t ON t.c = v.b AND t.p < v.h
        ), k AS MATERIALIZED (
            SELECT c, len, d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS k FROM r
            UNION ALL SELECT c, len, 0, '', '' FROM v
        ), g AS MATERIALIZED (
            SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(octet_length(encode(text))) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256
            FROM k GROUP BY d, k
        ), m AS MATERIALIZED (
            SELECT g.*, p.conv_id AS parent FROM g LEFT JOIN k ON k.c = g.conv_id AND k.d = g.d - 1 LEFT JOIN g p ON p.d = k.d AND p.k = k.k
        ), f AS (
            SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM m WHERE d > 0 GROUP BY 1, 2
        ), u AS (
            SELECT k.d, k.k, sum(CASE WHEN f.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(m.saved) AS saved
            FROM m LEFT JOIN f ON f.conv_id = m.conv_id AND f.d = m.d JOIN k ON k.c = m.conv_id AND k.d <= m.d GROUP BY k.d, k.k
        )
        SELECT m.conv_id, m.d AS depth, m.parent AS parent_conv_id, m.n_convs, coalesce(f.n, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM m JOIN u ON u.d = m.d AND u.k = m.k LEFT JOIN f ON f.conv_id = m.conv_id AND f.d = m.d
    """,
    "op13_bit_planes": lloyd_sql(8, 10, 1024.0, "3"),
    "op3_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.rid <> c.rid AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
}
