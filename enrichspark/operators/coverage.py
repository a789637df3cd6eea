"""Who is missing from a partly finished run, and scores re-weighted to the whole population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from enrichspark.functions.ordering import cumulative, global_rank, quantiles
from enrichspark.functions.resample import boot_means

#: Largest product of sample sizes for which p of the two-sample test is exact.
EXACT_PRODUCT = 100_000_000


def quantile_edges(values: DataFrame, value: str, q: int) -> list[float]:
    """Distinct edges of q quantile bins, smallest first (q + 1 numbers return to the driver)."""
    row = quantiles(values, value, {f"e{i}": i / q for i in range(q + 1)}).first()
    return sorted({row[f"e{i}"] for i in range(q + 1) if row[f"e{i}"] is not None})


def bin_right_closed(value: Column, edges: list[float]) -> Column:
    """Bin number from 0: (edge i, edge i+1], the first bin closed on both sides."""
    out = F.lit(None).cast("int")
    for i in reversed(range(1, len(edges))):
        out = F.when(value <= edges[i], i - 1).otherwise(out)
    return F.when(value < edges[0], None).otherwise(out)


def bin_left_closed(value: Column, edges: list[float]) -> Column:
    """Bin number from 0: [edge i, edge i+1), values beyond the ends go to the end bins."""
    last = max(len(edges) - 2, 0)
    out = F.lit(last)
    for i in reversed(range(1, last + 1)):
        out = F.when(value < edges[i], i - 1).otherwise(out)
    return F.when(value.isNotNull(), out)


def coverage_by(rows: DataFrame, group: Column, name: str) -> DataFrame:
    return rows.groupBy(group.alias(name)).agg(F.count("*").alias("n_universe"), F.count_if("done").alias("n_done"),
                                               F.avg(F.col("done").cast("double")).alias("pct_done"))


def position_deciles(rows: DataFrame, position: str, n: int = 10) -> DataFrame:
    """Add decile 1..n by run position, the quantile bins of the position's rank."""
    ranked = global_rank(rows, [position, "gene"], "_r").withColumn("_n", rows.agg(F.count("*").alias("n")).scalar())
    # (rank - 1) / (n - 1) is the quantile of the row; bins are closed on the right
    cut = F.ceil((F.col("_r") - 1) * n / F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.withColumn("decile", F.greatest(cut, F.lit(1)).cast("int")).drop("_r", "_n")


def property_bins(rows: DataFrame, value: str, q: int = 5) -> DataFrame:
    """Coverage by quantile bin of a property; empty if it has fewer than two distinct values."""
    known = rows.filter(F.col(value).isNotNull())
    edges = quantile_edges(known, value, q)
    if len(edges) < 2:
        return coverage_by(known.limit(0), F.lit(0), "bin")
    return coverage_by(known, bin_right_closed(F.col(value), edges), "bin")


def top_families(rows: DataFrame, family: str, n: int = 10) -> DataFrame:
    """Add a column that keeps the n largest families and folds the others together."""
    none, other = "(no family)", "(other families)"
    named = rows.withColumn("_f", F.coalesce(family, F.lit(none)))
    top = (named.filter(F.col("_f") != none).groupBy("_f").agg(F.count("*").alias("_n"))
           .orderBy(F.desc("_n"), "_f").limit(n).select("_f", F.lit(True).alias("_top")))
    label = F.when(F.col("_top") | (F.col("_f") == none), F.col("_f")).otherwise(other)
    return named.join(top, "_f", "left").withColumn("family_group", F.coalesce(label, F.lit(other))).drop("_f", "_top")


def mean_differences(rows: DataFrame, properties: list[str]) -> DataFrame:
    """Means of done and missing genes per property with the standardised mean difference (sample variance)."""
    pairs = [x for p in properties for x in (F.lit(p), F.col(p).cast("double"))]
    long = rows.select("done", F.explode(F.create_map(*pairs)).alias("property", "v")).filter(F.col("v").isNotNull())

    def side(f, flag):
        return f(F.when(F.col("done") == flag, F.col("v")))
    a = long.groupBy("property").agg(
        side(F.count, True).alias("n_done"), side(F.count, False).alias("n_missing"),
        side(F.avg, True).alias("mean_done"), side(F.avg, False).alias("mean_missing"),
        side(F.var_samp, True).alias("_v1"), side(F.var_samp, False).alias("_v0"))
    sd = F.sqrt((F.col("_v1") + F.col("_v0")) / 2)
    smd = (F.when((F.col("n_done") < 2) | (F.col("n_missing") < 2), None)
           .when(sd > 0, (F.col("mean_done") - F.col("mean_missing")) / sd).otherwise(0.0))
    return a.withColumn("smd", smd).drop("_v1", "_v0")


def ks_exact(n: int, m: int, gap: int) -> float:
    """Chance that two samples of n and m values from one distribution differ by gap / (n m) or more.

    Merged in order, the samples are a lattice path from (0, 0) to (n, m), all equally likely. Diagonal by diagonal the mass of the
    paths still inside the band moves on, and what reaches its edge is added up, so that small p keep their precision.
    """
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1, dtype=np.int64)
    inside, out = np.zeros(n + 1), 0.0
    inside[0] = 1.0
    for s in range(n + m):
        step = inside * np.maximum(m - (s - i), 0) / (n + m - s)
        step[1:] += inside[:-1] * (n - i[:-1]) / (n + m - s)
        edge = np.abs(i * m - (s + 1 - i) * n) >= gap
        out += step[edge].sum()
        step[edge] = 0
        inside = step
    return min(1.0, out)


def _ks_exact(n: pd.Series, m: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series([ks_exact(*x) for x in zip(n.tolist(), m.tolist(), gap.tolist())], dtype=float)


def ks_two_sample(rows: DataFrame, value: str, exact_product: int = EXACT_PRODUCT) -> DataFrame:
    """Largest gap between the two empirical distributions and its two-sided p.

    Counts per distinct value are ranked by range, so no task sees the whole column. p is exact up to exact_product = n_done x
    n_missing, the work of its recursion, and asymptotic beyond; null if one sample is empty.
    """
    per = (rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v"))
           .agg(F.count_if("done").alias("a"), F.count_if(~F.col("done")).alias("b")))
    gap = F.abs(F.col("a_upto") * F.col("b_total") - F.col("b_upto") * F.col("a_total"))
    stat = cumulative(per, ["v"], ["a", "b"]).agg(F.max(gap).alias("_gap"), F.first("a_total").alias("n_done"), F.first("b_total").alias("n_missing"))
    product = F.col("n_done") * F.col("n_missing")
    stat = stat.withColumn("statistic", F.col("_gap") / F.nullif(product, F.lit(0)))
    lam = F.col("statistic") * F.sqrt(product / (F.col("n_done") + F.col("n_missing")))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(-2.0 * j * j * F.col("_lam") * F.col("_lam")))
    far = F.when(F.col("_lam") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))
    near = product <= exact_product
    # the helper runs on every row it is given: beyond the limit it gets an empty case
    exact = F.pandas_udf(_ks_exact, "double")(*[F.when(near, F.col(c)).otherwise(0).cast("long") for c in ("n_done", "n_missing", "_gap")])
    return (stat.withColumn("_lam", lam).withColumn("p", F.when(product > 0, F.when(near, exact).otherwise(far)))
            .select("statistic", "n_done", "n_missing", "p"))


def reference_check(rows: DataFrame, values: list[str], hits: str, tests: str) -> DataFrame:
    """Known results of a full earlier run on done and on missing genes, and its match rate per tested term."""
    def side(c, flag):
        return F.avg(F.when(F.col("done") == flag, F.col(c).cast("double")))

    def ratio(flag):
        return (F.sum(F.when(F.col("done") == flag, F.col(hits))) / F.greatest(
            F.sum(F.when(F.col("done") == flag, F.col(tests))), F.lit(1)))
    cols = [f(c) for c in values for f in (lambda c: side(c, True).alias(f"{c}_done"),
                                           lambda c: side(c, False).alias(f"{c}_missing"))]
    return rows.agg(*cols, ratio(True).alias("per_term_done"), ratio(False).alias("per_term_missing"))


def strata(rows: DataFrame, population: DataFrame, a: str, qa: int, b: str, qb: int) -> DataFrame:
    """Add stratum from quantile bins of two properties whose edges come from the population."""
    ea, eb = quantile_edges(population, a, qa), quantile_edges(population, b, qb)
    return rows.withColumn("stratum", bin_left_closed(F.col(a), ea) * 10 + bin_left_closed(F.col(b), eb))


def stratum_weights(population: DataFrame, done: DataFrame) -> DataFrame:
    """(stratum, n_pop, n_done, weight): population over finished genes; weight is null where nothing is finished."""
    pop = population.groupBy("stratum").agg(F.count("*").alias("n_pop"))
    fin = done.groupBy("stratum").agg(F.count("*").alias("n_done"))
    return (pop.join(fin, "stratum", "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
            .withColumn("weight", F.when(F.col("n_done") > 0, F.col("n_pop") / F.col("n_done"))))


def post_stratify(population: DataFrame, done: DataFrame, metrics: list[str], min_per_stratum: int = 20) -> DataFrame:
    """One row: raw and re-weighted means, Kish effective n, thin strata and the uncovered share.

    population and done carry a stratum column.
    """
    w = stratum_weights(population, done)
    rows = done.join(w.select("stratum", "weight"), "stratum")
    means = rows.agg(*[F.avg(m).alias(f"{m}_raw") for m in metrics],
                     *[(F.sum(F.col("weight") * F.col(m)) / F.sum("weight")).alias(f"{m}_weighted") for m in metrics],
                     (F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("kish_n"),
                     F.max("weight").alias("max_weight"), F.count("*").alias("n_done"))
    side = w.agg(F.struct(
        F.count("*").alias("n_strata"), F.count_if(F.col("n_done") < min_per_stratum).alias("n_thin_strata"),
        (F.sum(F.when(F.col("n_done") == 0, F.col("n_pop")).otherwise(0)) / F.sum("n_pop")).alias("uncovered_share"))).scalar()
    return means.withColumn("_s", side).select("*", "_s.*").drop("_s")


def stratified_interval(population: DataFrame, done: DataFrame, metric: str, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """95% interval of the re-weighted mean; resampled stratum means are averaged with population weights.

    Resampling happens inside strata, so each stratum keeps its share.
    """
    w = stratum_weights(population, done)
    boots = (boot_means(done, ["stratum"], metric, "gene", n_boot, seed).join(w.select("stratum", "n_pop"), "stratum").groupBy("boot")
             .agg((F.sum(F.col("n_pop") * F.col("mean")) / F.sum("n_pop")).alias("mean")))
    return boots.agg(F.percentile("mean", F.lit(0.025)).alias("ci_lo"), F.percentile("mean", F.lit(0.975)).alias("ci_hi"))
