"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm import byte_bpe, chat, embedding_dedup, langid, line_dedup, maxscore, minhash_dedup, packing, quality, sharding
from pixelloom.llm.common import table
from pixelloom.llm.sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rank file of operator 10 and tokenizer file of operator 7.
BYTE_RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = P.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of SHARD_BYTES; small tables are one shard of depth 0."""
    return sharding.shards(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "shard", "shard_depth", "n_bytes")


def sharding_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with shards of 64 KiB, so that small tables split too."""
    return sharding.shards(table(spark, sf_dir, "documents"), ["doc_id"], "text", limit=1 << 16).select("doc_id", "shard", "shard_depth", "n_bytes")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document stands for its host."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_dropped")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, length=2048))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_RANKS, P.PATTERN)


QUERIES |= {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_language_id,
        op3_sharding,
        sharding_64k,
        op4_chat_formatting,
        op5_line_dedup,
        op6_quality,
        op7_packing,
        op8_maxscore,
        op9_minhash_dedup,
        op10_byte_bpe,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES["op3_sharding"] = sharding.oracle(sharding.SHARD_BYTES)
ORACLES["sharding_64k"] = sharding.oracle(1 << 16)
ORACLES["op4_chat_formatting"] = chat.ORACLE
ORACLES["op5_line_dedup"] = line_dedup.ORACLE
ORACLES["op8_maxscore"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
ORACLES["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.x = vec_id
"""
