"""Comparisons of conditions over the same genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.corrections import holm
from enrichspark.functions.resample import boot_means


def paired(scores: DataFrame, contrasts: DataFrame) -> DataFrame:
    """(contrast, gene, d): score differences on the genes both conditions share.

    scores is (condition, gene, score); contrasts is a small table (contrast, a, b).
    """
    a = scores.join(contrasts, scores["condition"] == contrasts["a"]).select("contrast", "b", "gene", F.col("score").alias("x"))
    b = scores.select(F.col("condition").alias("b"), "gene", F.col("score").alias("y"))
    return a.join(b, ["b", "gene"]).select("contrast", "gene", (F.col("x") - F.col("y")).alias("d"))


def interval(boots: DataFrame, keys: list[str], n_boot: int, value: str = "mean") -> DataFrame:
    """95% interval and two-sided p per key, from n_boot rows each."""
    below = F.avg(F.when(F.col(value) <= 0, 1.0).otherwise(0.0))
    above = F.avg(F.when(F.col(value) >= 0, 1.0).otherwise(0.0))
    p = F.least(F.lit(1.0), F.greatest(2 * F.least(below, above), F.lit(1.0 / (n_boot + 1))))
    return boots.groupBy(*keys).agg(F.percentile(value, F.lit(0.025)).alias("ci_lo"),
                                    F.percentile(value, F.lit(0.975)).alias("ci_hi"), p.alias("p"))


def paired_bootstrap(scores: DataFrame, contrasts: DataFrame, n_boot: int = 10000, seed: int = 0,
                     min_genes: int = 3) -> DataFrame:
    """Mean difference, interval and p per contrast, Holm-adjusted over the contrasts with enough genes."""
    d = paired(scores, contrasts)
    means = (d.groupBy("contrast").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"))
             .filter(F.col("n") >= min_genes))
    ci = interval(boot_means(d, ["contrast"], "d", "gene", n_boot, seed), ["contrast"], n_boot)
    rows = means.join(ci, "contrast").withColumn("_all", F.lit(1))
    return holm(rows, "p", ["_all"], "p_holm").drop("_all")


def means_table(scores: DataFrame, n_boot: int = 10000, seed: int = 0) -> DataFrame:
    """Mean score and interval per condition with at least two genes."""
    means = (scores.groupBy("condition").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).filter("n >= 2"))
    ci = interval(boot_means(scores, ["condition"], "score", "gene", n_boot, seed), ["condition"], n_boot)
    return means.join(ci, "condition").drop("p")


def signal_gate(scores: DataFrame, rungs: DataFrame, prior: str, n_boot: int = 10000, seed: int = 0) -> DataFrame:
    """A rung passes if it beats both the constant prior and its mismatched control with an interval above 0.

    rungs is a small table (rung, control).
    """
    contrasts = (rungs.select(F.concat_ws("|", "rung", F.lit("vs_prior")).alias("contrast"),
                              F.col("rung").alias("a"), F.lit(prior).alias("b"))
                 .unionByName(rungs.select(F.concat_ws("|", "rung", F.lit("vs_mismatched")).alias("contrast"),
                                           F.col("rung").alias("a"), F.col("control").alias("b"))))
    res = paired_bootstrap(scores, contrasts, n_boot, seed)
    low = {side: F.max(F.when(F.col("contrast").endswith(side), F.col("ci_lo"))) for side in ("vs_prior", "vs_mismatched")}
    return (res.groupBy(F.split("contrast", "[|]")[0].alias("rung"))
            .agg(low["vs_prior"].alias("ci_lo_prior"), low["vs_mismatched"].alias("ci_lo_mismatched"))
            .withColumn("passes", F.coalesce((F.col("ci_lo_prior") > 0) & (F.col("ci_lo_mismatched") > 0), F.lit(False))))


def verdict(gate: DataFrame) -> DataFrame:
    return gate.agg(F.when(F.coalesce(F.bool_or("passes"), F.lit(False)), "SIGNAL DETECTED").otherwise("INCONCLUSIVE").alias("verdict"),
                    F.coalesce(F.count_if("passes"), F.lit(0)).alias("n_passing"))


def group_difference(values: DataFrame, group: str, value: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of means between group = true and group = false with a bootstrap interval; needs 5 values each."""
    v = values.filter(F.col(value).isNotNull())
    boots = boot_means(v, [group], value, "gene", n_boot, seed)
    diff = boots.groupBy("boot").agg((F.max(F.when(F.col(group), F.col("mean")))
                                      - F.max(F.when(~F.col(group), F.col("mean")))).alias("mean"))
    means = v.agg(F.count_if(F.col(group)).alias("n_true"), F.count_if(~F.col(group)).alias("n_false"),
                  F.avg(F.when(F.col(group), F.col(value))).alias("mean_true"),
                  F.avg(F.when(~F.col(group), F.col(value))).alias("mean_false"))
    ci = diff.agg(F.struct(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))).scalar()
    enough = (F.col("n_true") >= 5) & (F.col("n_false") >= 5)
    return (means.withColumn("_ci", ci).withColumn("difference", F.col("mean_true") - F.col("mean_false"))
            .withColumn("ci_lo", F.when(enough, F.col("_ci.lo"))).withColumn("ci_hi", F.when(enough, F.col("_ci.hi"))).drop("_ci"))
