"""A corpus pipeline of five stages, each of which calls one training-data operator.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept and, but for the last, returns the columns of documents, in
their order and with columns beyond those of the table, whatever their names.
run() writes each stage's rows as Parquet and reads them again for the next.
An empty table gives an empty one in every stage; whole texts of any length
are read; rows that repeat go through as rows of their own up to the stage
that removes copies.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import langid, line_dedup, minhash_dedup, packing, quality
from pixelloom.llm.common import broadcast_if_small, table, written

#: Documents below these scores are rejected.
MIN_QUALITY, MIN_LANGUAGE = 0.5, 0.5
#: Ids that a broadcast may hold.
BROADCAST_IDS = 1_000_000


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with its own columns of these names put aside, for an operator that adds such columns."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in names})


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the columns of docs, those that were put aside among them."""
    return rows.select(*[F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in rows.columns else F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below MIN_QUALITY. Null and empty texts are scored too, as the empty text; a null id is never learned from; without labels all have 0.5 and stay."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return back(quality.score(aside(docs, "score"), net).where(F.col("score") >= MIN_QUALITY), docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null texts among them, and those whose language is unclear; a null lang becomes the predicted one. Without any lang to learn from nothing can be told, and all stay."""
    model = langid.fit(docs)
    if not model.languages:
        return docs
    got = langid.predict(aside(docs, "lang_pred", "score"), model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE))
    return back(got.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; whole copies stay for the next stage, and n_chars follows the text. Null sources are one source; null texts and ids stay."""
    got = line_dedup.drop_boilerplate(aside(docs, "n_dropped"), "source", "text", min_pages=5, spare_copies=True)
    return back(got.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and one row of it where rows repeat. Null and wordless texts are near nothing, a null id is never removed; an id that repeats with other texts keeps one row of each text."""
    found = written(minhash_dedup.near_duplicates(docs, shingle=5, percent=80))
    gone = written(found.where("not kept").select("doc_id").distinct())
    rest = docs.join(broadcast_if_small(gone, BROADCAST_IDS), "doc_id", "left_anti")
    again = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    repeated = broadcast_if_small(again, BROADCAST_IDS)
    return rest.join(repeated, "doc_id", "left_anti").unionByName(rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids' CRC-32. Null text is empty: its end of text alone; null ids and sources are kept as they are."""
    return packing.digests(packing.pack(docs, P.path("word_bpe_49k.json"), end_id=1, length=2048))


STAGES = [("quality", keep_quality), ("language", keep_language), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Trained models, MinHash and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
