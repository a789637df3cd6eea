"""Ontology files in OBO text: one stanza per row, read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(body): text of each [Term] stanza."""
    return (spark.read.option("lineSep", "\n\n").text(path).select(F.trim("value").alias("body"))
            .filter(F.col("body").startswith("[Term]")))


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """(version): the data-version line of the file header."""
    return (spark.read.text(path).filter(F.col("value").startswith("data-version:"))
            .select(F.trim(F.substring_index("value", "data-version:", -1)).alias("version")).limit(1))


def _one(tag: str) -> Column:
    v = F.regexp_extract("body", f"(?m)^{tag}: (.*)$", 1)
    return F.when(v != "", F.trim(v))


def _all(tag: str) -> Column:
    return F.regexp_extract_all("body", F.lit(f"(?m)^{tag}: (.*)$"), F.lit(1))


def obo_terms(stanzas: DataFrame) -> DataFrame:
    """(id, label, namespace, definition, status)."""
    definition = F.regexp_extract(_one("def"), '^"(.*)"', 1)
    return stanzas.select(_one("id").alias("id"), _one("name").alias("label"), _one("namespace").alias("namespace"),
                          F.when(definition != "", definition).alias("definition"),
                          F.when(F.col("body").rlike("(?m)^is_obsolete: true"), "OBSOLETE").otherwise("OK").alias("status"))


def obo_edges(stanzas: DataFrame) -> DataFrame:
    """(child, parent, rel) from is_a and relationship lines; trailing comments are cut."""
    is_a = stanzas.select(_one("id").alias("child"), F.explode(_all("is_a")).alias("v")) \
                  .select("child", F.trim(F.substring_index("v", "!", 1)).alias("parent"), F.lit("is_a").alias("rel"))
    rel = stanzas.select(_one("id").alias("child"), F.explode(_all("relationship")).alias("v")) \
                 .withColumn("v", F.split(F.trim(F.substring_index("v", "!", 1)), "\\s+")) \
                 .select("child", F.col("v")[1].alias("parent"), F.col("v")[0].alias("rel"))
    return is_a.unionByName(rel)


def obo_synonyms(stanzas: DataFrame) -> DataFrame:
    """(id, text, scope)."""
    pattern = '^"(.*)"\\s+(EXACT|BROAD|NARROW|RELATED)\\b'
    v = stanzas.select(_one("id").alias("id"), F.explode(_all("synonym")).alias("v")).filter(F.col("v").rlike(pattern))
    return v.select("id", F.regexp_extract("v", pattern, 1).alias("text"), F.regexp_extract("v", pattern, 2).alias("scope"))


def obo_alternatives(stanzas: DataFrame) -> DataFrame:
    """(alt_id, id)."""
    return stanzas.select(F.explode(_all("alt_id")).alias("alt_id"), _one("id").alias("id"))
