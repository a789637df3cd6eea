"""Feature contrasts and over-representation tests for every gene at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.corrections import benjamini_hochberg, bonferroni
from enrichspark.functions.exact import binomial_two_sided, fisher_two_sided, hypergeometric_tail
from enrichspark.session import spread, wide

MIN_FEATURE_COUNT = 20
MIN_EXCESS = 0.10
LOW_POWER_RATIO = 0.5


def called_features(obs: DataFrame, features: DataFrame) -> DataFrame:
    """(gene, item, value, kind, term): called observations with each feature of their item.

    Observations are dealt by gene first, into tasks sized by the rows that come of them, so that groups within a gene stay there.
    """
    called = obs.filter(F.col("value").isNotNull()).select("gene", "item", "value")
    return wide(called, _feature_rows(obs, features), "gene").join(features.select("item", "kind", "term"), "item")


def _feature_rows(obs: DataFrame, features: DataFrame) -> int:
    held = features.agg(F.count("*").alias("n"), F.count_distinct("item").alias("items")).first()
    return obs.count() * held["n"] // max(1, held["items"])


def feature_counts(obs: DataFrame, features: DataFrame) -> DataFrame:
    """(gene, kind, term, n_pos, n_neg): items of each feature where the gene is positive or negative."""
    return (called_features(obs, features).groupBy("gene", "kind", "term")
            .agg(F.count_if(F.col("value") == 1).alias("n_pos"), F.count_if(F.col("value") == 0).alias("n_neg")))


def _totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("gene").agg(F.count_if(F.col("value") == 1).alias("all_pos"),
                                   F.count_if(F.col("value") == 0).alias("all_neg"))


def fisher_enrichment(obs: DataFrame, features: DataFrame, min_feature_count: int = MIN_FEATURE_COUNT) -> DataFrame:
    """Two-sided exact test of each feature's positive and negative counts against the set sizes."""
    a, b, P, N = (F.col(c) for c in ("n_pos", "n_neg", "all_pos", "all_neg"))
    tested = spread(feature_counts(obs, features).filter(a + b >= min_feature_count).join(_totals(obs), "gene"), "gene",
                    rows=_feature_rows(obs, features) // max(1, min_feature_count))
    empty_margin = (P == 0) | (N == 0) | (a + b == 0) | (a + b == P + N)
    odds = (F.when(empty_margin, F.lit(None).cast("double"))
            .when((b > 0) & (P - a > 0), a * (N - b) / (b * (P - a))).otherwise(float("inf")))
    p = F.when(empty_margin, 1.0).otherwise(fisher_two_sided("n_pos", "n_neg", "all_pos", "all_neg"))
    rows = tested.select("gene", "kind", "term", "n_pos", "n_neg", odds.alias("odds_ratio"), p.alias("p"))
    return benjamini_hochberg(rows, "p", ["gene"], "q")


def _expected(rate, baseline, grand):
    return F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate * baseline / grand))


def two_factor_enrichment(obs: DataFrame, features: DataFrame, baselines: DataFrame, grand_mean,
                          min_feature_count: int = MIN_FEATURE_COUNT) -> DataFrame:
    """Exact binomial test against gene rate x feature baseline / grand mean.

    Features without a baseline are kept with tested = false, so the skipped ones can be counted.
    """
    a, n = F.col("n_pos"), F.col("n_pos") + F.col("n_neg")
    counted = (feature_counts(obs, features).filter(n >= min_feature_count).join(_totals(obs), "gene")
               .join(baselines.select("kind", "term", "baseline"), ["kind", "term"], "left"))
    rate = F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))
    rows = (spread(counted, "gene", rows=_feature_rows(obs, features) // max(1, min_feature_count)).withColumn("grand_mean", grand_mean)
            .withColumn("tested", F.col("baseline").isNotNull())
            .withColumn("expected", F.when(F.col("tested"), F.when(F.col("grand_mean") > 0, _expected(
                rate, F.col("baseline"), F.col("grand_mean"))).otherwise(rate)))
            .withColumn("observed", a / n))
    obs_odds = F.col("observed") / (1 - F.col("observed"))
    exp_odds = F.col("expected") / (1 - F.col("expected"))
    odds = (F.when(~F.col("tested"), F.lit(None).cast("double")).when(F.col("observed") >= 1, float("inf"))
            .when(F.col("observed") <= 0, 0.0).otherwise(obs_odds / exp_odds))
    rows = rows.select("gene", "kind", "term", "n_pos", "n_neg", "tested", "baseline", "expected",
                       (F.col("observed") - F.col("expected")).alias("excess"), odds.alias("odds_ratio"),
                       F.when(F.col("tested"), binomial_two_sided("n_pos", "n_pos + n_neg", "expected")).alias("p"))
    return benjamini_hochberg(rows, "p", ["gene"], "q")


def effect_floor(rows: DataFrame, min_excess: float = MIN_EXCESS) -> DataFrame:
    """Features whose excess is large enough to report, whatever their p."""
    return rows.filter(F.abs("excess") >= min_excess)


def tissue_homogeneity(obs: DataFrame, min_items: int = 15, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Per gene, the share of well covered tissues that are almost all positive or all negative."""
    per = (obs.filter(F.col("value").isNotNull()).groupBy("gene", "tissue")
           .agg(F.count("*").alias("n"), F.avg("value").alias("rate")))
    considered = F.col("n") >= min_items
    flagged = considered & ((F.col("rate") > high) | (F.col("rate") < low))
    return (per.groupBy("gene").agg(F.count_if(considered).alias("n_considered"), F.count_if(flagged).alias("n_flagged"))
            .withColumn("frac_flagged", F.when(F.col("n_considered") > 0, F.col("n_flagged") / F.col("n_considered"))
                        .otherwise(0.0)))


def over_representation(units: DataFrame, carriers: DataFrame, min_term_size: int = 3,
                        max_term_size: int = 0, query_value: int = 1) -> DataFrame:
    """Hypergeometric over-representation of terms among each gene's positive items.

    The background is the annotated items the gene is called for, at the unit given in `units`.
    query_value = 0 tests the negative set. Bonferroni and Benjamini-Hochberg run inside
    (unit, gene). Terms no query item carries are kept with p = 1.
    """
    annotated = carriers.select("ct").distinct()
    called = units.filter(F.col("value").isNotNull()).join(annotated, "ct", "left_semi")
    hit = F.count_if(F.col("value") == query_value)
    sizes = called.groupBy("unit", "gene").agg(F.count("*").alias("n_background"), hit.alias("query_size"))
    terms = (called.join(carriers.select("ct", "term"), "ct").groupBy("unit", "gene", "term")
             .agg(F.count("*").alias("term_size"), hit.alias("intersection"))
             .filter(F.col("term_size") >= min_term_size))
    if max_term_size:
        terms = terms.filter(F.col("term_size") <= max_term_size)
    N, n, K, k = (F.col(c) for c in ("n_background", "query_size", "term_size", "intersection"))
    rows = (spread(terms.join(sizes, ["unit", "gene"]).filter(n > 0), "unit", "gene")
            .withColumn("expected", n * K / N).withColumn("fold", k / F.col("expected"))
            .withColumn("precision", k / n).withColumn("recall", k / K)
            .withColumn("p", hypergeometric_tail("intersection", "n_background", "term_size", "query_size")))
    rows = bonferroni(rows, "p", ["unit", "gene"], "p_bonferroni")
    return benjamini_hochberg(rows, "p", ["unit", "gene"], "p_bh")


def diagnostics(rows: DataFrame, low_power_ratio: float = LOW_POWER_RATIO) -> DataFrame:
    """Per (unit, gene): query share of the background, the fold ceiling N/n and the low-power flag."""
    ratio = F.col("query_size") / F.col("n_background")
    return (rows.groupBy("unit", "gene").agg(F.first("n_background").alias("n_background"),
                                             F.first("query_size").alias("query_size"),
                                             F.count("*").alias("n_terms_tested"), F.max("fold").alias("max_fold"))
            .withColumn("query_background_ratio", ratio)
            .withColumn("max_fold_possible", F.col("n_background") / F.col("query_size"))
            .withColumn("low_power", ratio > low_power_ratio))
