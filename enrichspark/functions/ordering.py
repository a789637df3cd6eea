"""Ranks and quantiles over whole tables, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.session import materialize


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Add the 1-based position of each row under `order` (end it with a unique column).

    Rows are range partitioned, ranked inside each partition, and shifted by the sizes of the
    partitions before it. The partition number is written out first, so it cannot change.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "rank")
    sizes = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return parts.join(starts, "_pid").withColumn(out, F.col("_start") + inside).drop("_pid", "_start")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of `value`, one row per group of `by` (or one row in all).

    Equal values are counted first; groups may hold any share of the table.
    """
    by = by or []
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
               .agg(F.count("*").alias("_c")))
    parts = materialize(counted.repartitionByRange(*by, "_v").withColumn("_pid", F.spark_partition_id()), "quantile")
    w = Window.partitionBy(*by, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sizes = parts.groupBy(*by, "_pid").agg(F.sum("_c").alias("_n"))
    if by:
        before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(*by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    totals = sizes.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ends = (_match(parts.withColumn("_end", F.sum("_c").over(w)), starts, by + ["_pid"])
            .withColumn("_end", F.col("_start") + F.col("_end")))
    at = _match(ends, totals, by)
    first = F.col("_end") - F.col("_c")  # values hold positions first .. end-1

    def pick(p: float) -> Column:
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        share = pos - lo
        v = F.col("_v")
        low = F.max(F.when((first <= lo) & (lo < F.col("_end")), v))
        high = F.max(F.when((first <= hi) & (hi < F.col("_end")), v))
        return low + F.max(share) * (high - low)

    return at.groupBy(*by).agg(*[pick(p).alias(name) for name, p in probs.items()])


def cumulative(counts: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Add <name>_upto, the running total in `order`, and <name>_total to each row of a counted table.

    order must identify a row. Partitions are summed on their own and shifted by those before them.
    """
    parts = materialize(counts.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "cumulative")
    sizes = parts.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    totals = sizes.agg(F.struct(*[F.sum(c).alias(c) for c in sums]).alias("t")).scalar()
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(starts, "_pid").withColumn("_t", totals)
    for c in sums:
        out = out.withColumn(f"{c}_upto", F.col(f"_s_{c}") + F.sum(c).over(w)).withColumn(f"{c}_total", F.col(f"_t.{c}"))
    return out.drop("_pid", "_t", *[f"_s_{c}" for c in sums])


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the rank of `value` with ties sharing their mean rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = cumulative(counts, ["_v"], ["_c"]).select("_v", (F.col("_c_upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:  # right is a single row
        name = right.columns[0]
        return left.withColumn(name, right.select(name).scalar())
    cond = None
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])
