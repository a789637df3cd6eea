"""Split joins on heavy keys against plain joins."""

import pytest
from enrichspark.functions.skew import _splits, heavy_keys, split_join
from enrichspark.operators import dag, matching
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sides(spark):
    """A key that holds three quarters of the rows, a middle one, many small ones, and nulls."""
    big = spark.range(20_000).selectExpr("CASE WHEN id % 4 > 0 THEN 'root' WHEN id % 40 = 0 THEN 'mid' WHEN id % 44 = 0 THEN NULL ELSE 'k' || (id % 900) END k", "id v", "id % 3 w")
    small = spark.createDataFrame([("root", 1), ("root", 2), ("mid", 3), ("k8", 4), ("k8", 4), (None, 5), ("unheard", 6)], "k string, x int")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows(sides, how):
    big, small = sides
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=key)
    assert sorted(map(tuple, split_join(big, small, ["k"], "k", how, 500).collect()), key=key) == want
    with pytest.raises(ValueError):
        split_join(big, small, ["k"], "k", "full")


def test_no_task_reads_much_more_than_its_share(spark, sides):
    big, _ = sides
    heavy = heavy_keys(big, "k", 500)
    assert "root" in heavy and "k8" not in heavy and heavy_keys(big, "k") == {}
    fair = max(500, 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = _splits(heavy, F.col("k"))
    per = big.groupBy("k", F.when(n > 1, F.pmod(F.xxhash64(*big.columns), n)).otherwise(0)).count().agg(F.max("count")).first()[0]
    assert per <= 1.5 * fair


def test_operators_over_a_root_that_every_gene_carries(spark, monkeypatch):
    edges = spark.createDataFrame([(2, 1, "is_a"), (3, 1, "is_a"), (4, 2, "is_a")], "child int, parent int, rel string")
    closed = dag.closure(edges)
    terms = spark.range(3000).selectExpr("id gene", "CAST(IF(id % 5 = 0, id % 3 + 2, 4) AS INT) term")
    preds = spark.range(3000).selectExpr("id gene", "CAST(IF(id % 7 = 0, 3, 1) AS INT) term")
    plain = [sorted(map(tuple, x.collect())) for x in (dag.propagate(terms, closed, ["gene"]), matching.classify(preds, terms, closed).select("gene", "term", "kind", "distance"))]
    monkeypatch.setattr(split_join, "__defaults__", ("inner", 100, None))
    split = [sorted(map(tuple, x.collect())) for x in (dag.propagate(terms, closed, ["gene"]), matching.classify(preds, terms, closed).select("gene", "term", "kind", "distance"))]
    assert split == plain
