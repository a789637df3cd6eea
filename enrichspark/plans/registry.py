"""Registry of queries: a name, a builder taking the model, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from enrichspark.plans.model import Model, model
from enrichspark.plans.sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder f(model) under a name. sql may use the named fragments of plans.sql."""
    def wrap(f: Callable[[Model], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: f(model(spark, path))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return f
    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, integers as bigint."""
    def cast(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c, digits).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        return c
    return df.select(*[cast(f) for f in df.schema.fields])


def stable_p(p: str = "p") -> Column:
    """p with its exponent kept and the last digits rounded, so that equal tests tie and small ones keep their order."""
    return F.expr(f"pow(10, round(log10(CASE WHEN {p} < 1e-300 THEN 1e-300 ELSE {p} END), 9))")
