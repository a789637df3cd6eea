"""The exact two-sample test against enumeration."""

import itertools
import math

import pytest
from enrichspark.operators.coverage import ks_exact, ks_two_sample


def paths_inside(n, m, gap):
    """Lattice paths that stay inside the band, in whole numbers."""
    row = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = 1 if i == j == 0 else (row[i - 1][j] if i else 0) + (row[i][j - 1] if j else 0)
            row[i][j] = ways if abs(i * m - j * n) < gap or (gap <= 0) else 0
    return row[n][m]


def test_against_enumeration():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 6), (3, 7)):
        every = []
        for a in itertools.combinations(range(n + m), n):
            i = j = best = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in a else (i, j + 1)
                best = max(best, abs(i * m - j * n))
            every.append(best)
        for gap in set(every):
            assert ks_exact(n, m, gap) == pytest.approx(sum(b >= gap for b in every) / len(every), rel=1e-12)


def test_against_path_counts():
    for n, m in ((12, 12), (12, 11), (40, 25)):
        for gap in range(1, n * m + 1, 17):
            assert ks_exact(n, m, gap) == pytest.approx(1 - paths_inside(n, m, gap) / math.comb(n + m, n), rel=1e-9, abs=1e-13)


def test_large_samples_take_the_series(spark):
    rows = spark.range(3000).selectExpr("id % 2 = 0 done", "CAST(id % 97 + IF(id % 2 = 0, 4, 0) AS DOUBLE) v")
    exact, series = (ks_two_sample(rows, "v", limit).first() for limit in (10**8, 10))
    assert exact.statistic == series.statistic and abs(exact.p - series.p) < 0.01 and exact.p != series.p
    assert ks_two_sample(rows.filter("done"), "v").first().p is None
