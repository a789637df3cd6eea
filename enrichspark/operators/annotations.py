"""Gene annotation records: filters with a reason per removed row, mapping to genes, evidence codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED_EVIDENCE = ("IEA", "ND")


def mark_annotations(rows: DataFrame, idmap: DataFrame, terms: DataFrame, aspect: str = "P",
                     excluded: tuple[str, ...] = EXCLUDED_EVIDENCE) -> DataFrame:
    """Add primary_id and drop_reason to annotation rows; null is kept. Filters apply in a fixed order.

    rows is (row_id, accession, qualifier, term, evidence, aspect), idmap (gene, accession), terms
    (any_id, primary_id, is_process) with alternative ids included.
    """
    mapped = idmap.select("accession").distinct().withColumn("_mapped", F.lit(True))
    known = terms.select(F.col("any_id").alias("term"), "primary_id", "is_process")
    reason = (F.when(F.col("aspect") != aspect, "other_aspect")
              .when(F.col("qualifier").contains("NOT"), "not_qualified")
              .when(F.col("evidence").isin(*excluded), F.concat(F.lit("excluded_evidence_"), "evidence"))
              .when(F.col("_mapped").isNull(), "accession_unmapped")
              .when(~F.coalesce("is_process", F.lit(False)), "term_unresolved"))
    return (rows.join(mapped, "accession", "left").join(known, "term", "left")
            .withColumn("drop_reason", reason).drop("_mapped", "is_process"))


def filter_stats(marked: DataFrame) -> DataFrame:
    """Rows per outcome of the filters."""
    return marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def gene_annotations(marked: DataFrame, idmap: DataFrame) -> DataFrame:
    """(gene, term) of kept rows; an accession shared by several genes annotates each of them."""
    return (marked.filter(F.col("drop_reason").isNull()).join(idmap, "accession")
            .select("gene", F.col("primary_id").alias("term")).distinct())


def annotation_evidence(marked: DataFrame, idmap: DataFrame) -> DataFrame:
    """(gene, term, codes): sorted evidence codes behind each pair. The set of codes is a small fixed list."""
    return (marked.filter(F.col("drop_reason").isNull()).join(idmap, "accession")
            .groupBy("gene", F.col("primary_id").alias("term"))
            .agg(F.array_sort(F.collect_set("evidence")).alias("codes")))


def first_terms(ann: DataFrame, excluded: tuple[str, ...] = ("IEA",), n: int = 10) -> DataFrame:
    """The first n distinct terms of each gene with accepted evidence."""
    kept = ann.filter(~F.col("evidence").isin(*excluded)).select("gene", "term").distinct()
    w = Window.partitionBy("gene").orderBy("term")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
