"""Evidence tables, detection baselines and the corrected statistics built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.corrections import benjamini_hochberg
from enrichspark.functions.exact import binomial_two_sided
from enrichspark.operators.enrichment import called_features
from enrichspark.operators.vocabulary import with_every_term
from enrichspark.session import spread

MIN_GENES_CONTRIBUTING = 100


def called_universe(units: DataFrame, carriers: DataFrame) -> DataFrame:
    """Annotated items each gene has a call for."""
    return units.filter(F.col("value").isNotNull()).join(carriers.select("ct").distinct(), "ct", "left_semi")


def annotated_universe(units: DataFrame, carriers: DataFrame) -> DataFrame:
    """Items with at least one term, whether called or not."""
    return units.join(carriers.select("ct").distinct(), "ct", "left_semi").select("unit", "item").distinct()


def evidence_counts(units: DataFrame, carriers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(unit, gene, term, size, hits): called carriers of each candidate term and how many are positive."""
    kept = carriers.select("ct", "term").join(candidates.select("term"), "term", "left_semi")
    return (units.filter(F.col("value").isNotNull()).join(kept, "ct").groupBy("unit", "gene", "term")
            .agg(F.count("*").alias("size"), F.sum(F.col("value").cast("long")).alias("hits")))


def feature_baselines(obs: DataFrame, features: DataFrame, min_genes: int = MIN_GENES_CONTRIBUTING) -> DataFrame:
    """(kind, term, baseline, n_genes): mean over genes of each gene's own positive rate on the feature."""
    per_gene = called_features(obs, features).groupBy("gene", "kind", "term").agg(F.avg(F.col("value").cast("double")).alias("rate"))
    return (per_gene.groupBy("kind", "term")
            .agg(F.round(F.avg("rate"), 6).alias("baseline"), F.count("*").alias("n_genes"))
            .filter(F.col("n_genes") >= min_genes))


def term_baselines(evidence: DataFrame, min_genes: int = MIN_GENES_CONTRIBUTING) -> DataFrame:
    """(unit, term, baseline, n_genes) from the evidence table of both units."""
    return (evidence.filter("size > 0").groupBy("unit", "term")
            .agg(F.round(F.avg(F.col("hits") / F.col("size")), 6).alias("baseline"), F.count("*").alias("n_genes"))
            .filter(F.col("n_genes") >= min_genes))


def grand_means(rates: DataFrame) -> DataFrame:
    """(unit, grand_mean): mean of gene rates, genes without calls left out."""
    return rates.groupBy("unit").agg(F.round(F.avg("rate"), 6).alias("grand_mean"))


def corrected_stats(evidence: DataFrame, rates: DataFrame, baselines: DataFrame, grand: DataFrame,
                    candidates: DataFrame, min_term_size: int = 3) -> DataFrame:
    """Binomial test of every candidate term against the two-factor expectation.

    Terms with too few called carriers, no baseline or no evidence stay with tested = false and p = q = 1.
    """
    every = with_every_term(rates.select("unit", "gene", "rate"), candidates)
    rows = (every.join(evidence, ["unit", "gene", "term"], "left")
            .join(baselines.select("unit", "term", "baseline"), ["unit", "term"], "left")
            .join(grand, "unit")
            .withColumn("size", F.coalesce("size", F.lit(0))).withColumn("hits", F.coalesce("hits", F.lit(0)))
            .withColumn("tested", (F.col("size") >= min_term_size) & F.col("baseline").isNotNull()
                        & (F.col("grand_mean") > 0)))
    expected = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("rate") * F.col("baseline") / F.col("grand_mean")))
    observed = F.when(F.col("size") > 0, F.col("hits") / F.col("size")).otherwise(0.0)
    rows = (spread(rows, "unit", "gene").withColumn("observed", observed).withColumn("expected", F.when(F.col("tested"), expected))
            .withColumn("excess", F.col("observed") - F.col("expected"))
            .withColumn("_p", F.when(F.col("tested"), binomial_two_sided("hits", "size", "expected"))))
    rows = benjamini_hochberg(rows, "_p", ["unit", "gene"], "_q")
    return rows.select("unit", "gene", "term", "size", "hits", "observed", "expected", "excess", "tested",
                       F.coalesce("_p", F.lit(1.0)).alias("p"),
                       F.when(F.col("tested"), F.col("_q")).otherwise(1.0).alias("q"))
