"""Predicted terms against a gene's direct annotations, by distance in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.skew import split_join
from enrichspark.functions.text import distance_bin

KINDS = ("exact", "upward", "downward", "no_match")


def _up(truths: DataFrame, closed: DataFrame) -> DataFrame:
    """Nearest true term below each strict ancestor of a gene's true terms."""
    climbs = closed.filter("depth > 0").select(F.col("src").alias("term"), "src", "anc", "depth")
    return (split_join(truths.select("gene", "term"), climbs, ["term"], "term")
            .groupBy("gene", F.col("anc").alias("term"))
            .agg(F.min(F.struct("depth", F.col("src").alias("true"))).alias("up"),
                 F.array_sort(F.collect_set("src")).alias("below")))


def _down(preds: DataFrame, truths: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest true term above each predicted term."""
    above = closed.filter("depth > 0").select(F.col("src").alias("term"), "anc", "depth")
    climbs = (split_join(preds.select(*keys, "term").distinct(), above, ["term"], "term")
              .select(*keys, "term", "anc", "depth"))
    return (climbs.join(truths.select("gene", F.col("term").alias("anc")), ["gene", "anc"])
            .groupBy(*keys, "term").agg(F.min(F.struct("depth", F.col("anc").alias("true"))).alias("down")))


def relations(preds: DataFrame, truths: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """preds with exact (bool), up and down (depth, true) and below (true terms under the prediction)."""
    exact = truths.select("gene", "term").distinct().withColumn("exact", F.lit(True))
    return (preds.join(exact, ["gene", "term"], "left").join(_up(truths, closed), ["gene", "term"], "left")
            .join(_down(preds, truths, closed, keys), keys + ["term"], "left")
            .withColumn("exact", F.coalesce("exact", F.lit(False))))


def classify(preds: DataFrame, truths: DataFrame, closed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add kind, distance and matched_term. exact goes first, then upward, then downward.

    preds has (*keys, term), keys include gene. Among equally near true terms the smallest id is kept.
    also_down marks upward matches that also specialise another true term.
    """
    keys = keys or ["gene"]
    r = relations(preds, truths, closed, keys)
    kind = (F.when(F.col("exact"), "exact").when(F.col("up").isNotNull(), "upward")
            .when(F.col("down").isNotNull(), "downward").otherwise("no_match"))
    near = F.when(F.col("up").isNotNull(), F.col("up")).otherwise(F.col("down"))
    return (r.withColumn("kind", kind)
            .withColumn("distance", F.when(F.col("exact"), 0).otherwise(near["depth"]))
            .withColumn("matched_term", F.when(~F.col("exact"), near["true"]))
            .withColumn("also_down", F.when(F.col("kind") == "upward", F.col("down").isNotNull()))
            .drop("exact", "up", "down", "below"))


def relation_split(preds: DataFrame, truths: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Which directions relate a prediction to the truth, and which of them is nearer."""
    r = relations(preds, truths, closed, keys)
    up, down = F.col("up.depth"), F.col("down.depth")
    split = (F.when(F.col("exact"), "exact").when(up.isNull() & down.isNull(), "no_match")
             .when(down.isNull(), "up_only").when(up.isNull(), "only_down")
             .when(down < up, "both_down_closer").otherwise("both_up_closer_or_equal"))
    return r.select(*keys, "term", split.alias("split"), up.alias("d_up"), down.alias("d_down"),
                    F.coalesce(F.size("below"), F.lit(0)).alias("n_below"),
                    F.coalesce(F.array_join(F.transform("below", lambda x: x.cast("string")), ","), F.lit(""))
                    .alias("true_terms_below"))


def match_summary(classified: DataFrame, genes: DataFrame) -> DataFrame:
    """Per gene: number of predictions of each kind; genes without predictions count 0."""
    counts = classified.groupBy("gene").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    return genes.select("gene").join(counts, "gene", "left").fillna(0)


def distance_histogram(classified: DataFrame) -> DataFrame:
    """Matches by kind and distance bin."""
    return (classified.filter(F.col("kind").isin("upward", "downward"))
            .groupBy("kind", distance_bin(F.col("distance")).alias("bin")).agg(F.count("*").alias("n")))


def summary_totals(per_gene: DataFrame) -> DataFrame:
    """One row over all genes: totals by kind, genes without predictions, shares of exact and no_match."""
    total = sum((F.sum(f"n_{k}") for k in KINDS[1:]), F.sum("n_exact"))
    any_pred = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col("n_exact"))
    return per_gene.agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS], F.count("*").alias("n_genes"),
                        F.avg(F.when(any_pred == 0, 1.0).otherwise(0.0)).alias("frac_zero_predictions"),
                        (F.sum("n_exact") / F.nullif(total, F.lit(0))).alias("frac_exact"),
                        (F.sum("n_no_match") / F.nullif(total, F.lit(0))).alias("frac_no_match"))


def chance_baseline(every: DataFrame, truths: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """Per gene: share of the vocabulary that would match by kind, and IC of its true terms.

    every holds one row per gene and vocabulary term.
    """
    kinds = classify(every, truths, closed)
    share = kinds.groupBy("gene").agg(
        F.avg(F.when(F.col("kind") != "no_match", 1.0).otherwise(0.0)).alias("chance"),
        *[F.avg(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"chance_{k}") for k in KINDS[:3]])
    specificity = truths.join(ic, "term").groupBy("gene").agg(
        F.avg("ic").alias("mean_true_ic"), F.min("ic").alias("min_true_ic"), F.max("ic").alias("max_true_ic"))
    return share.join(specificity, "gene", "left")
