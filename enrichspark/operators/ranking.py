"""Ranked term predictions from test results. Partitions hold one gene's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.exact import neg_log10
from enrichspark.operators.vocabulary import with_every_term


def _rank(rows: DataFrame, keys: list[str], enriched: Column, effect: Column, by: str) -> DataFrame:
    up = F.coalesce(enriched, F.lit(False))
    group = F.when(~F.col("tested"), 2).when(up, 0).otherwise(1) if by == "p" else F.when(F.col("tested"), 0).otherwise(2)
    live_p = F.when(F.col("tested") & up, F.col("p")) if by == "p" else F.lit(None).cast("double")
    order = [group, live_p.asc_nulls_last(), effect.desc_nulls_last(), F.col("p"), F.col("term")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    score = F.when(F.col("tested") & up, neg_log10(F.col("p"))).otherwise(0.0)
    return rows.select(*keys, "term", rank.alias("rank"), score.alias("score"))


def rank_corrected(stats: DataFrame, by: str = "p", keys: list[str] | None = None) -> DataFrame:
    """Enriched terms by p, then the other tested terms by excess, then untested ones; by='effect' uses excess only."""
    return _rank(stats, keys or ["unit", "gene"], F.col("excess") > 0, F.round("excess", 12), by)


def rank_over_representation(rows: DataFrame, genes: DataFrame, candidates: DataFrame, by: str = "p") -> DataFrame:
    """The same for hypergeometric rows on fold > 1; candidates without a test come last."""
    every = with_every_term(genes.select("unit", "gene"), candidates)
    full = every.join(rows.select("unit", "gene", "term", "fold", "p"), ["unit", "gene", "term"], "left")
    full = full.withColumn("tested", F.col("p").isNotNull())
    return _rank(full, ["unit", "gene"], F.col("fold") > 1, F.round("fold", 12), by)


def significant_rank(rows: DataFrame, p: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Rank of each significant term of a gene by (p, term)."""
    w = Window.partitionBy(*(keys or ["gene"])).orderBy(p, "term")
    return rows.filter(F.col(p) < alpha).withColumn("rank", F.row_number().over(w))


def significant_terms(rows: DataFrame, version: str, alpha: float = 0.05) -> DataFrame:
    """The rows that count as significant under a scoring version, with the basis of the decision.

    Over-representation (v1, v2) goes by the corrected p, the statistics against baselines (v3, v4) by q of tested terms; other versions
    give no test, so that every ranked row counts.
    """
    if version in ("v1", "v2"):
        keep, basis = F.col("significant"), f"p_gscs < {alpha}"
    elif version in ("v3", "v4"):
        keep, basis = F.col("tested") & (F.round("q", 9) < alpha), f"q < {alpha}"
    else:
        keep, basis = F.lit(True), "none"
    return rows.filter(keep).withColumn("basis", F.lit(basis))


def top_effects(rows: DataFrame, n_enriched: int = 8, n_depleted: int = 5) -> DataFrame:
    """The strongest enriched and depleted features of each gene by absolute excess."""
    side = F.when(F.col("excess") > 0, "enriched").otherwise("depleted")
    w = Window.partitionBy("gene", "side").orderBy(F.round(F.abs("excess"), 12).desc(), "kind", "term")
    limit = F.when(F.col("side") == "enriched", n_enriched).otherwise(n_depleted)
    return (rows.filter("tested").withColumn("side", side).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= max(n_enriched, n_depleted)).filter(F.col("rank") <= limit))


def keep_first(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeated terms, keep the first occurrence and close the gaps in rank."""
    first = preds.groupBy(*keys, "term").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_r", "term")
    return first.withColumn("rank", F.row_number().over(w)).drop("_r")
