"""Operators over the long observation table obs(gene, item, ct, tissue, value): value is 1, 0 or null.

A null value means too little data. It counts as neither positive nor negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.ordering import global_rank

CELL_TYPES, ROWS = "cell_types", "rows"


def parse_pair(pair: Column) -> tuple[Column, Column]:
    """Cell type and tissue of a composite 'celltype|tissue' key."""
    parts = F.split(pair, "[|]")
    return parts[0], parts[1]


def positive_items(obs: DataFrame) -> DataFrame:
    return obs.filter("value = 1")


def negative_items(obs: DataFrame) -> DataFrame:
    return obs.filter("value = 0")


def expression_summary(obs: DataFrame) -> DataFrame:
    """Positive, negative, missing and total item counts of each gene over the whole item grid."""
    total = obs.agg(F.count_distinct("item").alias("n")).scalar()
    return (obs.groupBy("gene").agg(F.count_if(F.col("value") == 1).alias("n_positive"),
                                    F.count_if(F.col("value") == 0).alias("n_negative"))
            .withColumn("n_total", total)
            .withColumn("n_missing", F.col("n_total") - F.col("n_positive") - F.col("n_negative")))


def rank_by_missing(obs: DataFrame, max_positive_ratio: float | None = None) -> DataFrame:
    """Genes ranked by missing items, fewest first, optionally without broadly positive ones; equal counts by gene."""
    s = expression_summary(obs).withColumn("positive_ratio", F.col("n_positive") / F.col("n_total"))
    if max_positive_ratio is not None:
        s = s.filter(F.col("positive_ratio") <= max_positive_ratio)
    return global_rank(s, ["n_missing", "gene"])


def rollup_items(obs: DataFrame) -> DataFrame:
    """One value per (gene, ct): positive if any row is, null only if every row is."""
    return obs.groupBy("gene", "ct").agg(F.max("value").alias("value"))


def by_unit(obs: DataFrame) -> DataFrame:
    """Observations at both units of analysis: (unit, gene, item, ct, value)."""
    cell_types = rollup_items(obs).select(F.lit(CELL_TYPES).alias("unit"), "gene",
                                          F.col("ct").cast("string").alias("item"), "ct", "value")
    rows = obs.select(F.lit(ROWS).alias("unit"), "gene", "item", "ct", "value")
    return cell_types.unionByName(rows)


def gene_rates(units: DataFrame) -> DataFrame:
    """Positive and called items and positive rate per (unit, gene); the rate is null if nothing is called."""
    n_called = F.count("value")
    n_pos = F.coalesce(F.sum(F.col("value").cast("long")), F.lit(0))
    return units.groupBy("unit", "gene").agg(
        n_pos.alias("n_pos"), n_called.alias("n_called"),
        F.avg(F.col("value").cast("double")).alias("rate"))


def presence_check(genes: DataFrame, obs: DataFrame) -> DataFrame:
    """Requested genes with status 'present' or 'absent'."""
    known = obs.select("gene").distinct().withColumn("_known", F.lit(1))
    return genes.join(known, "gene", "left").select(
        "gene", F.when(F.col("_known").isNull(), "absent").otherwise("present").alias("status"))


def unpivot_matrix(lines: DataFrame, header: DataFrame) -> DataFrame:
    """Long form of text lines (item, values as an array) with header(position, gene)."""
    cells = lines.select("item", F.posexplode("cells").alias("position", "cell"))
    value = F.when(F.trim("cell") == "", None).otherwise(F.col("cell").cast("double").cast("int"))
    return cells.join(header, "position").select("gene", "item", value.alias("value"))
