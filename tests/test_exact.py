import math
import random

import pytest

from enrichspark.functions.exact import binomial_two_sided, fisher_two_sided, hypergeometric_tail, neg_log10


def tail(k, N, K, n):
    hi = min(K, n)
    return sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(max(k, 0, n + K - N), hi + 1)) / math.comb(N, n)


def two_sided(masses, k):
    return min(1.0, sum(m for m in masses.values() if m <= masses[k] * (1 + 1e-7)))


def test_published_tails(spark):
    df = spark.createDataFrame([(3, 10, 4, 5), (80, 359, 84, 285), (33, 359, 84, 118)], "k int, a int, b int, n int")
    got = [r[0] for r in df.select(hypergeometric_tail("k", "a", "b", "n")).collect()]
    assert got == pytest.approx([0.261904761905, 6.310954611e-06, 0.097988661239], rel=1e-9)


def test_tail_matches_exact_integers(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(300):
        N = rng.randint(1, 400)
        K, n = rng.randint(0, N), rng.randint(0, N)
        cases.append((rng.randint(0, min(K, n) + 1), N, K, n))
    df = spark.createDataFrame(cases, "k int, a int, b int, n int")
    for r in df.withColumn("p", hypergeometric_tail("k", "a", "b", "n")).collect():
        assert r["p"] == pytest.approx(tail(r["k"], r["a"], r["b"], r["n"]), rel=1e-9, abs=1e-15)


def test_far_tail_keeps_precision(spark):
    df = spark.createDataFrame([(400, 4000, 400, 400)], "k int, a int, b int, n int")
    got = df.select(neg_log10(hypergeometric_tail("k", "a", "b", "n"))).first()[0]
    exact = -(math.log10(1) - math.log10(math.comb(4000, 400)))
    assert exact > 300 and got == 300.0
    df = spark.createDataFrame([(150, 4000, 400, 200)], "k int, a int, b int, n int")
    got = df.select(neg_log10(hypergeometric_tail("k", "a", "b", "n"))).first()[0]
    num = sum(math.comb(400, i) * math.comb(3600, 200 - i) for i in range(150, 201))
    assert got == pytest.approx(math.log10(math.comb(4000, 200)) - math.log10(num), rel=1e-10)


def test_large_counts_take_work_of_the_deviation(spark):
    df = spark.createDataFrame([(1_000_000, 10**9, 10**7, 10**8)], "k long, a long, b long, n long")
    assert df.select(hypergeometric_tail("k", "a", "b", "n")).first()[0] == pytest.approx(0.5, abs=1e-3)


def test_fisher(spark):
    df = spark.createDataFrame([(8, 2, 10, 10)], "a int, b int, P int, N int")
    assert df.select(fisher_two_sided("a", "b", "P", "N")).first()[0] == pytest.approx(0.023014137565, rel=1e-9)
    rng = random.Random(2)
    cases = [(rng.randint(0, P), rng.randint(0, N), P, N) for P, N in ((rng.randint(1, 60), rng.randint(1, 60)) for _ in range(200))]
    df = spark.createDataFrame(cases, "a int, b int, x int, y int").withColumn("p", fisher_two_sided("a", "b", "x", "y"))
    for r in df.collect():
        n, P, N = r["a"] + r["b"], r["x"], r["y"]
        masses = {i: math.comb(P, i) * math.comb(N, n - i) / math.comb(P + N, n) for i in range(max(0, n - N), min(P, n) + 1)}
        assert r["p"] == pytest.approx(two_sided(masses, r["a"]), rel=1e-8)


def test_binomial(spark):
    df = spark.createDataFrame([(8, 10, 0.4), (7, 20, 0.5)], "k int, n int, p double")
    got = [r[0] for r in df.select(binomial_two_sided("k", "n", "p")).collect()]
    assert got == pytest.approx([0.018341171200, 0.263175964355], rel=1e-9)
    rng = random.Random(3)
    cases = [(rng.randint(0, n), n, rng.choice([0.001, 0.2, 0.5, 0.731, 0.999])) for n in (rng.randint(1, 150) for _ in range(200))]
    df = spark.createDataFrame(cases, "k int, n int, p double").withColumn("q", binomial_two_sided("k", "n", "p"))
    for r in df.collect():
        masses = {i: math.comb(r["n"], i) * r["p"]**i * (1 - r["p"])**(r["n"] - i) for i in range(r["n"] + 1)}
        assert r["q"] == pytest.approx(two_sided(masses, r["k"]), rel=1e-7, abs=1e-300)


