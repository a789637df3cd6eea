"""Widths of the exchanges that helpers ask for."""

from pyspark.sql import functions as F

from enrichspark.session import spread


def test_spread_stays_after_an_aggregation_on_its_keys(spark):
    counted = spark.range(1000).select((F.col("id") % 100).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    assert spread(counted, "k").rdd.getNumPartitions() > 1
    again = spread(counted, "k").groupBy("k").agg(F.sum("n").alias("n"))
    assert again.rdd.getNumPartitions() > 1 and again.filter("n = 10").count() == 100


def test_feature_counts_in_tasks_by_rows(spark, monkeypatch):
    from enrichspark import session
    from enrichspark.operators import enrichment

    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    obs = spark.range(3000).select((F.col("id") % 60).alias("gene"), (F.col("id") % 50).cast("string").alias("item"), (F.col("id") % 2).cast("int").alias("value"))
    features = spark.range(100).select((F.col("id") % 50).cast("string").alias("item"), F.lit("k").alias("kind"), (F.col("id") % 5).cast("string").alias("term"))
    counts = enrichment.feature_counts(obs, features)
    assert counts.rdd.getNumPartitions() == 60
    assert counts.agg(F.sum(F.col("n_pos") + F.col("n_neg"))).first()[0] == 6000
