"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with fewer rows than this is never split.
MIN_SPLIT = 100_000
#: Counters of the frequent-items sketch; its error is the row count over about three quarters of them.
COUNTERS = 8192


def heavy_keys(df: DataFrame, key: str, min_split: int = MIN_SPLIT) -> dict:
    """Splits for each key of df that holds more rows than a shuffle partition should.

    One pass with a frequent-items sketch, whose size is fixed: at most one key per shuffle partition returns.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = max(1, min(parts, 1000))
    row = df.filter(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {max(COUNTERS, 2 * k)})").alias("top")).first()
    fair = max(min_split, math.ceil(row.n / parts))
    return {r["item"]: math.ceil(r["count"] / fair) for r in row.top or () if r["count"] > fair}


def split_join(big: DataFrame, small: DataFrame, on: list[str], key: str, how: str = "inner", min_split: int = MIN_SPLIT,
               source: DataFrame | None = None) -> DataFrame:
    """big.join(small, on, how), with the heavy keys of big dealt over several tasks.

    Rows of a heavy key get a split number from a hash of the row, and the rows of small with that key are repeated once per split; all
    others stay as they are. key is one of on; source, if given, is a cheaper table with the same share of its keys. how may be inner, left, left_semi or left_anti, which look at one row of big at a time.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} join can't repeat its right side")
    heavy = heavy_keys(big if source is None else source, key, min_split)
    if not heavy:
        return big.join(small, on, how)
    splits = _splits(heavy, F.col(key))
    dealt = big.withColumn("_split", F.when(splits > 1, F.pmod(F.xxhash64(*big.columns), splits)).otherwise(0).cast("int"))
    repeated = small.withColumn("_split", F.explode(F.sequence(F.lit(0), splits.cast("int") - 1)))
    return dealt.join(repeated, [*on, "_split"], how).drop("_split")


def _splits(heavy: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(heavy.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(1))
