"""The simulated null against random sets drawn one by one."""

import hashlib
import math
import random

import numpy as np
from enrichspark.operators import simulate


def tail(k, N, K, n):
    return sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, min(K, n) + 1)) / math.comb(N, n)


def test_thresholds_against_brute_force(spark):
    rng = random.Random(8)
    cts = list(range(75))  # more than one word of bits
    held = {ct: {t for t in range(9) if rng.random() < (0.1 + 0.05 * t)} for ct in cts}
    rows = []
    for unit, width in (("cell_types", 1), ("rows", 2)):
        for gene in range(55):
            share, hit = rng.random(), rng.random()
            for ct in cts:
                for k in range(width):
                    rows.append((unit, gene, f"{ct}|{k}" if width > 1 else str(ct), ct, None if rng.random() < share * 0.5 else int(rng.random() < hit)))
    units = spark.createDataFrame(rows, "unit string, gene long, item string, ct int, value int")
    carriers = spark.createDataFrame([(ct, t) for ct, ts in held.items() for t in ts], "ct int, term int")
    grid = simulate.item_grid(units, carriers)
    genes = simulate.universes(units, grid)
    got = {(r.unit, r.gene): r.threshold for r in genes.join(simulate.null_thresholds(genes, grid, carriers, 3, 60), ["unit", "universe", "n"]).collect()}
    assert len({r.universe.__repr__() for r in genes.collect()}) >= 100
    for unit in ("cell_types", "rows"):
        for gene in range(0, 55, 6):
            mine = [(item, ct, v) for u, g, item, ct, v in rows if (u, g) == (unit, gene) and v is not None and held[ct]]
            n, N = sum(v for *_, v in mine), len(mine)
            if not n:
                assert (unit, gene) not in got
                continue
            size = {t: sum(t in held[ct] for _, ct, _ in mine) for t in range(9)}
            least = []
            for sim in range(1, 61):
                order = sorted(mine, key=lambda x: (int(hashlib.md5(f"0|{sim}|{x[0]}".encode()).hexdigest()[:8], 16), x[0]))[:n]
                least.append(min(tail(sum(t in held[ct] for _, ct, _ in order), N, K, n) for t, K in size.items() if K >= 3))
            assert abs(got[unit, gene] - np.quantile(least, 0.05)) <= 1e-9 * got[unit, gene] + 1e-15


def test_universe_without_terms(spark):
    units = spark.createDataFrame([("rows", 1, "a", 1, 1), ("rows", 1, "b", 2, 0)], "unit string, gene long, item string, ct int, value int")
    carriers = spark.createDataFrame([(1, 5), (2, 6)], "ct int, term int")
    grid = simulate.item_grid(units, carriers)
    genes = simulate.universes(units, grid)
    null = simulate.null_thresholds(genes, grid, carriers, 3, 5)
    assert null.count() == 0
    rows = spark.createDataFrame([("rows", 1, 5, 3, 1, 2, 0.04)], "unit string, gene long, term int, term_size long, query_size long, n_background long, p double")
    out = simulate.apply_thresholds(rows, genes, null).first()
    assert out.threshold == 0.05 and abs(out.p_gscs - 0.04) < 1e-12 and out.significant
    assert simulate.null_thresholds(genes.limit(0), grid.limit(0), carriers).count() == 0


def test_simulations_of_a_universe_in_slabs(monkeypatch):
    rng = np.random.default_rng(3)
    place = np.argsort(rng.random((40, 90)), axis=1)
    universe, held = rng.random(90) < 0.6, rng.random((5, 90)) < 0.3
    held &= universe
    tails = [np.sort(rng.random(91))[::-1].tolist() for _ in held]
    want = []
    for row in place:
        first = sorted(np.flatnonzero(universe), key=lambda i: row[i])[:7]
        want.append(min(t[h[first].sum()] for t, h in zip(tails, held)))
    for cells in (1 << 22, 100):  # all simulations at once, and one or two at a time
        monkeypatch.setattr(simulate, "CELLS", cells)
        assert np.array_equal(simulate._smallest(place, universe, 7, held, tails), want)
