"""Set-counts-and-sizes correction: the null distribution of the smallest p over random item sets.

Sets of items are bit masks over the item grid of a unit. A simulation is one random order of all items, and its first n items in a universe
are the set drawn from it, whatever the universe. Orders are made once; a block of universes meets all orders of its unit, and numpy counts
the overlaps with the terms for all simulations of a universe at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.draws import hash32
from enrichspark.functions.exact import hypergeometric_tail
from enrichspark.session import materialize, spread

#: Cases of universe and number of items that meet a copy of the orders together.
CASES = 512
#: Simulations times items that are held at once.
CELLS = 1 << 22


def item_grid(units: DataFrame, carriers: DataFrame) -> DataFrame:
    """(unit, item, ct, bit): annotated items with their bit, numbered within the unit in the order of items."""
    items = units.join(carriers.select("ct").distinct(), "ct", "left_semi").select("unit", "item", "ct").distinct()
    return materialize(items.withColumn("bit", F.row_number().over(Window.partitionBy("unit").orderBy("item")) - 1), "grid")


def _mask(words: int) -> Column:
    """The rows' bits as an array of 64-bit words, an aggregate."""
    own = F.expr("shiftleft(1L, bit % 64)")
    parts = [F.bit_or(F.when(F.expr(f"bit div 64 = {w}"), own)) for w in range(words)]
    return F.array(*[F.coalesce(p, F.lit(0).cast("long")) for p in parts])


def _both(x: str, y: str, words: int) -> str:
    """Bits that two masks share."""
    return "(" + " + ".join(f"bit_count({x}[{w}] & {y}[{w}])" for w in range(words)) + ")"


def _words(grid: DataFrame) -> int:
    last = grid.agg(F.max("bit")).first()[0]
    return 0 if last is None else last // 64 + 1


def universes(units: DataFrame, grid: DataFrame) -> DataFrame:
    """(unit, gene, universe, n_items, n): the mask of a gene's called items, their number, and how many are positive."""
    words = _words(grid)
    called = units.filter(F.col("value").isNotNull()).join(grid.drop("ct"), ["unit", "item"])
    return called.groupBy("unit", "gene").agg(_mask(max(1, words)).alias("universe"), F.count("*").alias("n_items"),
                                              F.count_if(F.col("value") == 1).alias("n"))


def random_orders(grid: DataFrame, n_simulations: int, seed: int) -> DataFrame:
    """(unit, sim, bits): the items' bits in the random order of each simulation."""
    sims = grid.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_simulations))))
    place = F.struct(hash32(seed, F.col("sim"), F.col("item")).alias("h"), "item", "bit")
    return sims.groupBy("unit", "sim").agg(F.array_sort(F.collect_list(place)).alias("o")).select("unit", "sim", F.expr("transform(o, x -> x.bit)").alias("bits"))


def _bits(words: np.ndarray, size: int) -> np.ndarray:
    """Rows of 64-bit words as rows of bits."""
    return np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8), axis=-1, count=size, bitorder="little")


def _smallest(place: np.ndarray, universe: np.ndarray, n: int, held: np.ndarray, tails: list[list[float]]) -> np.ndarray:
    """Per simulation the smallest p of the terms, given each item's place (simulations x items) and the terms' items (terms x items)."""
    items = np.flatnonzero(universe)
    mine = held[:, items].T.astype(np.float64)
    tables, out = [np.array(t) for t in tails], np.empty(len(place))
    step = max(1, CELLS // len(items))
    for lo in range(0, len(place), step):
        own = place[lo:lo + step, items]
        first = own <= np.partition(own, n - 1, axis=1)[:, n - 1:n]
        overlap = (first.astype(np.float64) @ mine).astype(np.intp)
        out[lo:lo + step] = np.minimum.reduce([t[k] for t, k in zip(tables, overlap.T)])
    return out


def _quantile(x: np.ndarray, alpha: float) -> float:
    """Linear interpolation between the two nearest values."""
    at = (len(x) - 1) * alpha
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    x = np.partition(x, [lo, hi])
    return float(x[lo] if lo == hi else (hi - at) * x[lo] + (at - lo) * x[hi])


def _block_thresholds(alpha: float):
    def run(cases: pa.Table, orders: pa.Table) -> pa.Table:
        rows = cases.select(["universe", "n", "terms"]).to_pylist()
        found = []
        if rows:
            bits = orders["bits"].combine_chunks().flatten().to_numpy().reshape(orders.num_rows, -1)
            place = np.argsort(bits, axis=1).astype(np.int32)
            for r in rows:
                held = _bits(np.array([t["held"] for t in r["terms"]]), place.shape[1])
                least = _smallest(place, _bits(np.array(r["universe"]), place.shape[1]), r["n"], held, [t["tail"] for t in r["terms"]])
                found.append(_quantile(least, alpha))
        return cases.select(["unit", "universe", "n"]).append_column("threshold", pa.array(found, pa.float64()))
    return run


def null_thresholds(genes: DataFrame, grid: DataFrame, carriers: DataFrame, min_term_size: int = 3,
                    n_simulations: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(unit, universe, n, threshold): alpha quantile of the smallest p over random sets of n items of the universe.

    Work follows distinct (universe, n) times simulations. The terms of a universe travel as masks with their tails of p by overlap: as
    many as the vocabulary holds. A universe without a term of min_term_size items has no row. A task holds the orders of one unit.
    """
    words = _words(grid)
    if not words:
        return genes.select("unit", "universe", "n", F.lit(None).cast("double").alias("threshold")).limit(0)
    asked = materialize(genes.filter("n > 0").select("unit", "universe", "n_items", "n").distinct(), "asked")
    masks = grid.join(carriers.select("ct", "term").distinct(), "ct").groupBy("unit", "term").agg(_mask(words).alias("held"))
    held = (asked.join(masks, "unit").withColumn("held", F.expr("zip_with(held, universe, (x, y) -> x & y)"))
            .withColumn("term_size", F.expr(_both("held", "universe", words)).cast("long")).filter(F.col("term_size") >= min_term_size))
    held = materialize(held, "held")
    # equal counts give equal tails: one per distinct (n_items, term_size, n), indexed by the overlap
    tails = (held.select("n_items", "term_size", "n").distinct().withColumn("k", F.explode(F.expr("sequence(0L, least(term_size, n))")))
             .withColumn("p", hypergeometric_tail("k", "n_items", "term_size", "n")).groupBy("n_items", "term_size", "n")
             .agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("t")).withColumn("tail", F.expr("transform(t, e -> e.p)")).drop("t"))
    terms = (held.join(tails, ["n_items", "term_size", "n"]).groupBy("unit", "universe", "n")
             .agg(F.collect_list(F.struct("held", "tail")).alias("terms")))
    blocks = max(1, -(-asked.count() // CASES))
    orders = materialize(random_orders(grid, n_simulations, seed), "orders").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cases = terms.withColumn("block", F.pmod(F.xxhash64("universe", "n"), F.lit(blocks)).cast("int"))
    q = (spread(cases, "unit", "block").groupBy("unit", "block").cogroup(spread(orders, "unit", "block").groupBy("unit", "block"))
         .applyInArrow(_block_thresholds(alpha), "unit string, universe array<bigint>, n bigint, threshold double"))
    tiny = 2.2250738585072014e-308  # smallest normal double, a fixed value
    return q.withColumn("threshold", F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(tiny))


def apply_thresholds(rows: DataFrame, genes: DataFrame, thresholds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add threshold, p_gscs, p_floor, reachable and significant to over-representation rows."""
    per_gene = (genes.join(thresholds, ["unit", "universe", "n"], "left")
                .select("unit", "gene", F.coalesce("threshold", F.lit(alpha)).alias("threshold")))
    floor = hypergeometric_tail("least(term_size, query_size)", "n_background", "term_size", "query_size")
    return (spread(rows.join(per_gene, ["unit", "gene"]), "unit", "gene")
            .withColumn("p_gscs", F.least(F.lit(1.0), F.col("p") * (alpha / F.col("threshold"))))
            .withColumn("p_floor", floor)
            .withColumn("reachable", F.col("p_floor") <= F.col("threshold") * (1 + 1e-9))
            .withColumn("significant", F.col("p") * (alpha / F.col("threshold")) < alpha * (1 - 1e-9)))
