"""Reproducible samples and splits. Draws are orders of hashes, so they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.draws import hash32
from enrichspark.functions.ordering import global_rank, quantiles

#: Genes of a ring that one window looks at together.
RING_BLOCK = 1 << 14


def run_seed(run_id: Column, seed: int) -> Column:
    """Seed of a run: the first 32 bits of sha256 of its id, xor the global seed."""
    head = F.conv(F.substring(F.sha2(run_id.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return head.bitwiseXOR(F.lit(seed).cast("long"))


def eligibility(genes: DataFrame, smoke: Column, min_terms: int = 3, rate_min: float = 0.05, rate_max: float = 0.60,
                room_quantile: float = 0.25) -> DataFrame:
    """Add status to genes(gene, n_direct_terms, rate, room): smoke, excluded:<reason> or eligible.

    The room cut-off is a quantile of the genes that pass every other criterion.
    """
    early = (F.when(smoke, "smoke").when(F.col("room").isNull(), "excluded:not_scoreable")
             .when(F.col("n_direct_terms") < min_terms, "excluded:sparse_annotation")
             .when(~F.coalesce(F.col("rate").between(rate_min, rate_max), F.lit(False)), "excluded:rate_out_of_range"))
    staged = genes.withColumn("_early", early)
    cut = quantiles(staged.filter(F.col("_early").isNull()), "room", {"cut": room_quantile}).scalar()
    late = F.when(F.col("room") < F.col("_cut"), "excluded:low_room").otherwise("eligible")
    return (staged.withColumn("_cut", cut).withColumn("status", F.coalesce("_early", late)).drop("_early", "_cut"))


def stratum(genes: DataFrame, propagated: DataFrame, candidates: DataFrame) -> DataFrame:
    """carrying, not_carrying or unscoreable, by whether a gene's propagated terms meet the candidates."""
    flags = (propagated.join(candidates.select("term").withColumn("_c", F.lit(1)), "term", "left")
             .groupBy("gene").agg(F.max(F.col("_c").isNotNull()).alias("_carries")))
    return (genes.join(flags, "gene", "left")
            .withColumn("stratum", F.when(F.col("_carries").isNull(), "unscoreable")
                        .when(F.col("_carries"), "carrying").otherwise("not_carrying")).drop("_carries"))


def split_by_hash(genes: DataFrame, salt: str, n_dev: int = 40, n_test: int = 120, n_diag: int = 30) -> DataFrame:
    """Split eligible genes(gene, stratum): the first carrying genes in sha256 order are dev, then test; the rest are held.

    Diagnostic not_carrying genes all go to test. Positions come from a range-partitioned rank, because a
    stratum may hold most genes.
    """
    key = F.sha2(F.concat_ws("|", F.lit(salt), F.col("gene").cast("string")), 256)
    ranked = global_rank(genes.withColumn("_key", key), ["stratum", "_key"], "_r")
    starts = ranked.groupBy("stratum").agg(F.min("_r").alias("_first"))
    at = ranked.join(starts, "stratum").withColumn("position", F.col("_r") - F.col("_first") + 1)
    split = (F.when(F.col("stratum") == "carrying", F.when(F.col("position") <= n_dev, "dev")
                    .when(F.col("position") <= n_dev + n_test, "test").otherwise("held"))
             .otherwise(F.when(F.col("position") <= n_diag, "test").otherwise("held")))
    return at.withColumn("split", split).drop("_key", "_r", "_first")


def balanced_sample(obs: DataFrame, k: int = 40, seed: int = 0) -> DataFrame:
    """Up to k positive and k negative items per gene, in a shuffled order without labels showing."""
    w = Window.partitionBy("gene", "value").orderBy(hash32(seed, F.col("gene"), F.col("item")), "item")
    picked = obs.filter(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    mix = Window.partitionBy("gene").orderBy(hash32(seed, "mix", F.col("gene"), F.col("item")), "item")
    return picked.select("gene", "item", "ct", "tissue", (F.col("value") == 1).alias("is_positive"),
                         (F.row_number().over(mix) - 1).alias("index"))


def overlap_rate(sample: DataFrame, obs: DataFrame) -> DataFrame:
    """Per gene: share of the sample whose cell type is positive in one tissue and negative in another."""
    both = (obs.filter(F.col("value").isNotNull()).groupBy("gene", "ct")
            .agg((F.min("value") != F.max("value")).alias("ambiguous")))
    rows = sample.join(both, ["gene", "ct"])
    return rows.groupBy("gene").agg(
        F.count_if("is_positive").alias("n_positive"), F.count_if(~F.col("is_positive")).alias("n_negative"),
        F.count_distinct("ct").alias("n_cell_types"),
        F.avg(F.when(F.col("ambiguous"), 1.0).otherwise(0.0)).alias("overlap_rate"))


def distractor_genes(all_genes: DataFrame, annotated: DataFrame, n: int = 3, max_redraws: int = 10,
                     seed: int = 42, reach: int | None = None, block_rows: int = RING_BLOCK) -> DataFrame:
    """(gene, donor, place): the next n annotated genes on a hash ring of all genes.

    Genes without terms are passed over and counted; the walk ends after max_redraws of them, so a gene may get
    fewer than n. One shared ring replaces a shuffle per gene: only the next n + max_redraws + 1 ring
    neighbours of each gene are ever looked at. The ring is cut into blocks, each followed by the neighbours that its last
    genes look at, so it is shuffled once and neither joined nor broadcast.
    """
    reach = reach or n + max_redraws + 1
    flags = (all_genes.select("gene", F.lit(True).alias("_in"), F.lit(False).alias("ok"))
             .unionByName(annotated.select("gene", F.lit(False).alias("_in"), F.lit(True).alias("ok")))
             .groupBy("gene").agg(F.max("_in").alias("_in"), (F.max("ok") & F.col("gene").isNotNull()).alias("ok")))
    ring = global_rank(flags.filter("_in").select("gene", "ok").withColumn("_h", hash32(seed, "ring", F.col("gene"))), ["_h", "gene"], "_at")
    total = ring.agg(F.count("*").alias("n")).scalar()
    # places count from 0; the first ones follow the last once more
    place = F.col("_at") - 1
    turns = F.when(place < reach, F.array(place, place + F.col("_n"))).otherwise(F.array(place))
    seen = ring.withColumn("_n", total).select("gene", "ok", "_n", F.explode(turns).alias("_v"))
    first = F.expr(f"greatest(_v - {reach}, 0) div {block_rows}")
    last = F.least(F.expr(f"_v div {block_rows}"), F.expr(f"(_n - 1) div {block_rows}"))
    dealt = seen.filter(first <= last).withColumn("_block", F.explode(F.sequence(first, last)))
    ahead = Window.partitionBy("_block").orderBy("_v").rowsBetween(1, reach)
    met = (dealt.withColumn("_next", F.collect_list(F.struct(F.col("gene").alias("donor"), "ok")).over(ahead))
           .filter(F.col("_v") < F.least(F.col("_n"), (F.col("_block") + 1) * block_rows))
           .filter(F.col("_v") >= F.col("_block") * block_rows)
           .select("gene", F.slice("_next", F.lit(1), F.least(F.lit(reach), F.col("_n") - 1).cast("int")).alias("_next")))

    def walk(acc, x):
        place = acc["place"] + F.when(x["ok"], 1).otherwise(0)
        redraws = acc["redraws"] + F.when(x["ok"], 0).otherwise(1)
        hit = F.array(F.struct(x["donor"].alias("donor"), place.alias("place"), redraws.alias("redraws")))
        kept = F.when(x["ok"] & (place <= n) & (redraws <= max_redraws), F.concat(acc["found"], hit)).otherwise(acc["found"])
        return F.struct(place.alias("place"), redraws.alias("redraws"), kept.alias("found"))

    kind = dict(all_genes.select("gene").dtypes)["gene"]
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("redraws"),
                     F.array().cast(f"array<struct<donor:{kind},place:int,redraws:int>>").alias("found"))
    return (met.select("gene", F.explode(F.aggregate("_next", start, walk)["found"]).alias("x"))
            .select("gene", "x.donor", "x.place", "x.redraws"))


def distractor_terms(donors: DataFrame, terms: DataFrame, top_n: int = 10) -> DataFrame:
    """First top_n terms of each donor gene."""
    w = Window.partitionBy("gene").orderBy("term")
    first = terms.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
    return donors.join(first.select(F.col("gene").alias("donor"), "term"), "donor").select("gene", "donor", "term")
