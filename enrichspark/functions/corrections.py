"""Multiple-testing corrections inside families given by key columns.

The first three functions are for families such as the terms tested for one entity or the contrasts of one
report, whose size follows the vocabulary and not the data. `adjust_large` takes families of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.session import materialize


def bonferroni(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    m = F.count(p).over(Window.partitionBy(*family))
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * m))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Step-up q-values: the running minimum of p * m / rank from the largest p down."""
    w = Window.partitionBy(*family)
    ranked = (df.withColumn("_m", F.count(p).over(w))
              .withColumn("_r", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))))
    tail = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(tail)))
            .drop("_m", "_r"))


def holm(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Step-down adjustment: the running maximum of (m - rank + 1) * p."""
    w = Window.partitionBy(*family)
    ranked = (df.withColumn("_m", F.count(p).over(w))
              .withColumn("_r", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))))
    head = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.withColumn(out, F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(head)))
            .drop("_m", "_r"))


def adjust_large(df: DataFrame, p: str, family: list[str], tie: list[str], bonferroni_out: str, bh_out: str, holm_out: str) -> DataFrame:
    """All three corrections for families of any size, say every row of a table.

    Rows are range partitioned by family, p and `tie` (which makes them unique), so one family may span many
    tasks. Ranks and running minima inside a partition are completed from a table with one row per family and
    partition. Every p must be known.
    """
    parts = materialize(df.repartitionByRange(*family, p, *tie).withColumn("_pid", F.spark_partition_id()), "adjust")
    here = Window.partitionBy(*family, "_pid").orderBy(p, *tie)
    sizes = parts.groupBy(*family, "_pid").agg(F.count("*").alias("_n"))
    by_pid = Window.partitionBy(*family).orderBy("_pid")  # one row per partition
    starts = sizes.select(*family, "_pid", F.sum("_n").over(Window.partitionBy(*family)).alias("_m"), F.coalesce(
        F.sum("_n").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = (parts.join(starts, family + ["_pid"]).withColumn("_r", F.col("_start") + F.row_number().over(here))
              .withColumn("_up", F.col(p) * F.col("_m") / F.col("_r"))
              .withColumn("_down", (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    ends = ranked.groupBy(*family, "_pid").agg(F.min("_up").alias("_u"), F.max("_down").alias("_d")).select(
        *family, "_pid", F.min("_u").over(by_pid.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
        F.max("_d").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    one = F.lit(1.0)
    tail = F.min("_up").over(here.rowsBetween(0, Window.unboundedFollowing))
    head = F.max("_down").over(here.rowsBetween(Window.unboundedPreceding, 0))
    return (ranked.join(ends, family + ["_pid"])
            .withColumn(bonferroni_out, F.least(one, F.col(p) * F.col("_m")))
            .withColumn(bh_out, F.least(one, tail, F.col("_later")))
            .withColumn(holm_out, F.least(one, F.greatest(head, F.col("_earlier"))))
            .drop("_pid", "_m", "_start", "_r", "_up", "_down", "_later", "_earlier"))
