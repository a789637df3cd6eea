import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from enrichspark.functions.corrections import adjust_large, benjamini_hochberg, bonferroni, holm
from enrichspark.functions.draws import hash32, mix
from enrichspark.functions.resample import mixed
from enrichspark.functions.ordering import average_ranks, cumulative, global_rank, quantiles
from enrichspark.functions.text import distance_bin, normalise


def test_corrections_example(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "id int, p double").withColumn("f", F.lit(1))
    got = holm(benjamini_hochberg(df, "p", ["f"], "bh"), "p", ["f"], "holm")
    assert rows(got, "id", "bh", "holm") == [(1, 0.02, 0.03), (2, 0.04, 0.06), (3, 0.04, 0.06), (4, 0.02, 0.02)]


def test_untested_rows_do_not_count(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5)], "id int, p double").withColumn("f", F.lit(1))
    got = {r["id"]: r["q"] for r in benjamini_hochberg(df, "p", ["f"], "q").filter("p IS NOT NULL").collect()}
    assert got == {1: 0.02, 3: 0.5}


def test_large_families_match_small_ones(spark):
    """Half of all rows sit in one family, and a third of its p values are equal."""
    rng = random.Random(5)
    data = [(i, 0 if rng.random() < 0.5 else rng.randint(1, 9), 1.0 if rng.random() < 0.3 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, f int, p double")
    small = holm(benjamini_hochberg(bonferroni(df, "p", ["f"], "b"), "p", ["f"], "q"), "p", ["f"], "h")
    large = adjust_large(df, "p", ["f"], ["id"], "b", "q", "h")
    for a, b in zip(rows(small, "id", "b", "q", "h"), rows(large, "id", "b", "q", "h")):
        assert a == pytest.approx(b, rel=1e-12)


def test_quantiles_match_linear_interpolation(spark):
    rng = random.Random(7)
    data = [(g, round(rng.gauss(0, 1), 1)) for g in range(4) for _ in range(rng.randint(1, 300))]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r["g"]: r for r in quantiles(df, "v", {"a": 0.05, "m": 0.5, "z": 0.975}, ["g"]).collect()}
    for g in range(4):
        v = [x for h, x in data if h == g]
        for name, p in (("a", 0.05), ("m", 0.5), ("z", 0.975)):
            assert got[g][name] == pytest.approx(float(np.quantile(v, p)), abs=1e-9)
    assert quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(statistics.median(x for _, x in data))


def test_global_rank_and_cumulative(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = rows(global_rank(df, ["v", "id"], "r"), "r", "v", "id")
    want = sorted(((i * 37) % 101, i) for i in range(1000))
    assert [(v, i) for _, v, i in got] == want and [r for r, _, _ in got] == list(range(1, 1001))
    c = cumulative(df.groupBy("v").agg(F.count("*").alias("n")), ["v"], ["n"]).orderBy("v").collect()
    assert c[-1]["n_upto"] == 1000 == c[0]["n_total"] and c[0]["n_upto"] == c[0]["n"]


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id int, v double")
    assert rows(average_ranks(df, "v", "r"), "id", "r") == [(1, 2.5), (2, 2.5), (3, 1.0), (4, 4.0)]


def test_draws(spark):
    assert spark.range(1).select(hash32(0, 7, 3) % 100).first()[0] == 67
    pairs = spark.range(300).select((hash32("g", F.col("id")) % 2147483647).alias("a"), (F.col("id") * 1664525 % 2147483647).alias("b"))
    got = pairs.select("a", "b", mix(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == mixed(np.array([r.a for r in got]), np.array([r.b for r in got])).tolist()


def test_text_functions(spark):
    d = spark.createDataFrame([(1,), (4,), (5,), (6,), (11,), (None,)], "d int").select(distance_bin(F.col("d"))).collect()
    assert [r[0] for r in d] == ["d=1", "3<d<=5", "3<d<=5", "5<d<=10", "d>10", None]
    t = spark.createDataFrame([("G-protein  Coupled, (x)",)], "t string").select(normalise(F.col("t"))).first()[0]
    assert t == "g protein coupled x"
