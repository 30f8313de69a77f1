"""From raw documents to token ids in five stages. Each stage works on all rows that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelode.llm import decontamination, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from gamelode.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Only texts without a letter are rejected: one that two languages explain equally well stays, and so do all
    with a letter where no row has a label. The parser learns from the labelled rows of documents alone, as the query of
    operator 7 does."""
    labelled = read(spark, sf_dir, "documents").filter(~language_id.is_held_out() & (F.col("lang") != language_id.UNDETERMINED))
    samples = language_id.training_samples(labelled) or (("any", ""),)
    out = language_id.identify(docs.select(*COLUMNS), samples)
    return out.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, with source as the host. All documents stay; their texts lose the boilerplate lines."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five-word shingles with a similarity of 0.8 or more: the smallest doc_id of a group stays."""
    groups = minhash_dedup.near_duplicates(docs, words=5)
    drop = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(drop, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a document that holds a benchmark passage goes."""
    out = decontamination.find_passages(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return out.filter(F.size("spans") == 0).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of every text that is left, with their number."""
    out = sentencepiece_codec.encode(docs.select(*COLUMNS))
    return out.select("doc_id", "lang", "source", F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  #: SQL expresses neither the cross-parsing nor the encoding; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not encode_pieces:
            docs = stored(docs, f"pipeline-{name}")
    return docs
