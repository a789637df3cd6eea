"""Donor genes of similar rate, found without comparing genes pairwise.

Every gene sits on a hash ring. A target's donors are the next genes on the ring whose rate lies within the
tolerance. Rates are counted in millionths, so tolerance bands are exact integer ranges, and each range
is covered by a few dyadic blocks of the rate axis. Within a block, genes are numbered in ring order
(split into arcs, so that a block holding many genes is spread over tasks), and a target reads the numbers
after its own place with an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 60
LEVELS = 20  # blocks up to 2**20 millionths cover every rate


def _ring_position(seed: int, key: str):
    text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, RING_BITS // 4), 16, 10).cast("long")


def ring_donors(rates: DataFrame, tolerance: float = 0.05, k: int = 1, seed: int = 42, arcs_log2: int = 6) -> DataFrame:
    """(gene, donor, place): k donors of each gene of rates(gene, rate), nearest on the ring first.

    A donor differs from its gene and its rate is within the tolerance. A gene with fewer than k such
    donors gets them again in turn, so that every gene with a donor has k.
    """
    micro = F.round(F.col("rate") * 1000000).cast("long")
    tol = round(tolerance * 1000000)
    genes = (rates.filter(F.col("rate").isNotNull())
             .select("gene", micro.alias("r"), _ring_position(seed, "gene").alias("pos")))
    arc = F.shiftright("pos", RING_BITS - arcs_log2)
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    donors = (genes.withColumn("level", F.explode(levels))
              .select(F.col("level"), F.expr("shiftright(r, level)").alias("block"), arc.alias("arc"), "pos", "gene",
                      F.lit(0).alias("asks")))
    lo, hi = F.greatest(F.col("r") - tol, F.lit(0)), F.col("r") + tol + 1
    spans = (genes.withColumn("lo", lo).withColumn("hi", hi).withColumn("level", F.explode(levels))
             .withColumn("l", F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)"))
             .withColumn("h", F.expr("shiftright(hi, level)")).filter("l < h"))
    edges = F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("h") % 2 == 1, F.col("h") - 1))
    probes = (spans.withColumn("block", F.explode(F.filter(edges, lambda x: x.isNotNull())))
              .select("level", "block", arc.alias("arc"), "pos", "gene", F.lit(1).alias("asks")))
    # blocks nobody asks about carry most of the donor copies: drop them before the sort
    asked = probes.select("level", "block").distinct()
    rows = donors.join(asked, ["level", "block"], "left_semi").unionByName(probes)
    here = (Window.partitionBy("level", "block", "arc").orderBy("pos", "gene", "asks")
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_in_arc", F.sum(1 - F.col("asks")).over(here))
    sizes = rows.groupBy("level", "block", "arc").agg(F.sum(1 - F.col("asks")).alias("_n"))
    order = Window.partitionBy("level", "block").orderBy("arc")  # at most 2**arcs_log2 rows
    starts = sizes.select(
        "level", "block", "arc",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("level", "block")).alias("_size"))
    placed = (placed.join(starts, ["level", "block", "arc"])
              .withColumn("number", F.col("_start") + F.col("_in_arc")))
    supply = placed.filter("asks = 0").select("level", "block", "number", F.col("gene").alias("donor"),
                                              F.col("pos").alias("d_pos"))
    # one step more than k: the target itself may be among the next ones after a full turn
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(k + 1).cast("long"), F.col("_size")))
    demand = (placed.filter("asks = 1 AND _size > 0").withColumn("step", F.explode(steps))
              .select("level", "block", "gene", "pos",
                      ((F.col("number") + F.col("step") - 1) % F.col("_size") + 1).alias("number")))
    ring = 1 << RING_BITS
    near = (demand.join(supply, ["level", "block", "number"]).filter(F.col("gene") != F.col("donor"))
            .withColumn("gap", (F.col("d_pos") - F.col("pos") + ring) % ring))
    place = F.row_number().over(Window.partitionBy("gene").orderBy("gap", "donor"))  # some tens of rows per gene
    picked = near.withColumn("place", place).filter(F.col("place") <= k)
    # a gene with n < k donors takes them in turn until it has k
    n = F.count("*").over(Window.partitionBy("gene")).cast("int")
    return picked.withColumn("n", n).select("gene", "donor", F.explode(F.sequence("place", F.lit(k), F.col("n"))).alias("place"))


def mismatched_evidence(rankings: DataFrame, donors: DataFrame, keys: list[str]) -> DataFrame:
    """Rankings re-keyed from the gene they were made for to the genes that borrow them."""
    shown = rankings.withColumnRenamed("gene", "donor")
    return shown.join(donors.select("gene", "donor"), "donor").select("gene", *[k for k in keys if k != "gene"], "term", "rank")


def shuffled_baseline(preds: DataFrame, donors: DataFrame) -> DataFrame:
    """A gene's own predictions under each donor's name: (target, gene, place, term, rank), ready to be classified."""
    return (preds.withColumnRenamed("gene", "target")
            .join(donors.select(F.col("gene").alias("target"), F.col("donor").alias("gene"), "place"), "target"))


def shuffled_rates(classified: DataFrame, targets: DataFrame, top: int = 3) -> DataFrame:
    """Per target gene, means over its donors: predictions of each kind, any match, any exact match, any match in the first `top`.

    classified is shuffled_baseline with a kind per row. Targets without predictions or donors keep their row, with nulls.
    """
    match, exact = F.col("kind") != "no_match", F.col("kind") == "exact"
    kinds = {f"shuffled_{k}": F.count_if(F.col("kind") == k) for k in ("exact", "upward", "downward", "no_match")}
    flags = {"shuffled_any_match": match, "shuffled_any_exact": exact, f"shuffled_match_at_{top}": match & (F.col("rank") <= top)}
    per = classified.groupBy("target", "place").agg(
        *[c.alias(n) for n, c in kinds.items()], *[F.max(c.cast("int")).alias(n) for n, c in flags.items()])
    means = per.groupBy("target").agg(*[F.avg(n).alias(n) for n in (*kinds, *flags)])
    return targets.select(F.col("gene").alias("target")).join(means, "target", "left")
