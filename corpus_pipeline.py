"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, one stage after the other.

Every stage takes all documents that the one before kept. Stages other than the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.llm import decontaminate, langid, lines, near, packing
from enrichspark.llm.common import materialize, table

#: A text whose most likely language has a smaller probability than this, and explains its bytes less well than even odds
#: among the known languages do, is in no known language. The probability alone is small for any short text.
MIN_LANGUAGE_SCORE = 0.5
MIN_LANGUAGE_LIFT = 1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those in no known language; a missing lang is filled in."""
    out = langid.predict(docs, langid.train(docs), "lang_lift")
    known = (F.col("score") >= MIN_LANGUAGE_SCORE) | (F.col("lang_lift") >= MIN_LANGUAGE_LIFT)
    out = out.filter((F.col("lang_pred") != langid.UNKNOWN) & known)
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that many documents share. A document that loses all of them stays, with an empty text."""
    own = tuple(c for c in docs.columns if c != "text")
    out = lines.drop_lines(docs, own).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    gone = near.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_leaks),
    ("packing", pack_tokens),
]
#: Language ID and packing are outside SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
