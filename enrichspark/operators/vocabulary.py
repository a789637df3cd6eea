"""Small helpers around term vocabularies, whose size is set by the ontology and not by the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_every_term(df: DataFrame, vocabulary: DataFrame, out: str = "term") -> DataFrame:
    """Repeat each row once per vocabulary term, without a join or a shuffle."""
    terms = vocabulary.agg(F.array_sort(F.collect_set("term")).alias("terms")).scalar()
    return df.withColumn(out, F.explode(terms))


def candidate_vocabulary(carriers: DataFrame, min_term_size: int = 3) -> DataFrame:
    """Terms carried by at least min_term_size distinct annotated cell types."""
    return (carriers.groupBy("term").agg(F.count_distinct("ct").alias("n_cell_types"))
            .filter(F.col("n_cell_types") >= min_term_size))


def broad_vocabulary(propagated: DataFrame, ic: DataFrame, root, min_genes: int = 100) -> DataFrame:
    """Terms annotated to at least min_genes genes after propagation, informative and not the root."""
    counts = propagated.groupBy("term").agg(F.count("*").alias("n_genes"))
    return (counts.join(ic, "term")
            .filter((F.col("n_genes") >= min_genes) & (F.col("ic") > 0) & (F.col("term") != root)))
