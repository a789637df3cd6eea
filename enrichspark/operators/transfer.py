"""Co-annotation transfer: gene-level terms predicted from enriched evidence terms, leaving the gene itself out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.skew import split_join
from enrichspark.functions.exact import hypergeometric_tail, neg_log10
from enrichspark.operators.vocabulary import broad_vocabulary
from enrichspark.session import spread

MAX_ASSOCIATION = 300.0


def associations(propagated: DataFrame, ic: DataFrame, candidates: DataFrame, root, min_genes: int = 30) -> DataFrame:
    """(c, term, n_c, n_t, joint, s, s00, s01, s10, s11) of candidate c and gene-level term.

    s uses every gene. sXY leaves out one gene that carries c (X) and the term (Y): removing a gene changes
    the counts in only four ways, so all leave-one-out tables are these four columns.
    A gene contributes |its candidates| x |its terms| pairs, both bounded by the ontology.
    """
    vocab = broad_vocabulary(propagated, ic, root, min_genes).select("term", F.col("n_genes").alias("n_t"))
    carries = propagated.join(candidates.select("term"), "term", "left_semi").withColumnRenamed("term", "c")
    n_c = carries.groupBy("c").agg(F.count("*").alias("n_c"))
    held = propagated.join(vocab.select("term"), "term", "left_semi")
    joint = carries.join(held, "gene").groupBy("c", "term").agg(F.count("*").alias("joint"))
    total = propagated.agg(F.count_distinct("gene").alias("m")).scalar()
    rows = spread(joint.join(n_c, "c").join(vocab, "term"), "c", "term").withColumn("m", total)

    def strength(dj, dc, dt, dm):
        j, c, t, m = F.col("joint") - dj, F.col("n_c") - dc, F.col("n_t") - dt, F.col("m") - dm
        tail = hypergeometric_tail(f"joint - {dj}", f"m - {dm}", f"n_t - {dt}", f"n_c - {dc}")
        return F.when(j > c * t / m, F.least(F.lit(MAX_ASSOCIATION), neg_log10(tail, MAX_ASSOCIATION))).otherwise(0.0)

    return rows.select("c", "term", "n_c", "n_t", "joint", strength(0, 0, 0, 0).alias("s"),
                       strength(0, 0, 0, 1).alias("s00"), strength(0, 0, 1, 1).alias("s01"),
                       strength(0, 1, 0, 1).alias("s10"), strength(1, 1, 1, 1).alias("s11"))


def evidence_weights(stats: DataFrame) -> DataFrame:
    """(unit, gene, c, w): -log10 p of the enriched tested terms."""
    return (stats.filter(F.col("tested") & (F.col("excess") > 0))
            .select("unit", "gene", F.col("term").alias("c"), neg_log10(F.col("p")).alias("w")).filter("w > 0"))


def transfer_rank(weights: DataFrame, assoc: DataFrame, propagated: DataFrame, keys: list[str],
                  top_n: int = 100, leave_out: bool = True, target: str = "gene") -> DataFrame:
    """(*keys, term, rank, score): score = sum over evidence terms of weight x association.

    `target` names the gene to leave out; with evidence of another gene it differs from the evidence gene.
    Both sums, for targets with and without the term, are built before the gene's own terms are looked up, so
    the lookup runs on one row per target and term.
    """
    own = propagated.select(F.col("gene").alias(target), F.col("term").alias("c")).withColumn("_c", F.lit(1))
    has_c = F.col("_c").isNotNull()
    sums = (split_join(weights.join(own, [target, "c"], "left"), assoc, ["c"], "c", source=weights).groupBy(*keys, "term").agg(
        F.sum(F.col("w") * F.col("s")).alias("all"),
        F.sum(F.col("w") * F.when(has_c, F.col("s10")).otherwise(F.col("s00"))).alias("without"),
        F.sum(F.col("w") * F.when(has_c, F.col("s11")).otherwise(F.col("s01"))).alias("with")))
    if not leave_out:
        scored = sums.withColumn("score", F.col("all"))
    else:
        held = propagated.select(F.col("gene").alias(target), "term").withColumn("_t", F.lit(1))
        known = propagated.select(F.col("gene").alias(target)).distinct().withColumn("_g", F.lit(1))
        scored = (sums.join(held, [target, "term"], "left").join(known, target, "left")
                  .withColumn("score", F.when(F.col("_g").isNull(), F.col("all"))
                              .when(F.col("_t").isNotNull(), F.col("with")).otherwise(F.col("without"))))
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "term")
    return (scored.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
            .select(*keys, "term", "rank", "score"))


def transfer_explain(weights: DataFrame, assoc: DataFrame, propagated: DataFrame, keys: list[str],
                     top_c: int = 5, top_t: int = 5) -> DataFrame:
    """The strongest evidence terms of each gene with their most associated gene-level terms.

    The gene itself is left out of the counts; one without any annotation is in none of them.
    """
    wc = Window.partitionBy(*keys).orderBy(F.round("w", 9).desc(), "c")
    best = weights.withColumn("c_rank", F.row_number().over(wc)).filter(F.col("c_rank") <= top_c)
    own_c = propagated.select("gene", F.col("term").alias("c")).withColumn("_c", F.lit(1))
    own_t = propagated.select("gene", "term").withColumn("_t", F.lit(1))
    known = propagated.select("gene").distinct().withColumn("_g", F.lit(1))
    best = best.join(own_c, ["gene", "c"], "left").join(known, "gene", "left")
    rows = split_join(best, assoc, ["c"], "c", source=weights).join(own_t, ["gene", "term"], "left")
    c, t = F.col("_c").isNotNull(), F.col("_t").isNotNull()
    s = (F.when(F.col("_g").isNull(), F.col("s")).when(c & t, F.col("s11")).when(c, F.col("s10")).when(t, F.col("s01")).otherwise(F.col("s00")))
    wt = Window.partitionBy(*keys, "c").orderBy(F.round("assoc", 9).desc(), "term")
    return (rows.withColumn("assoc", s).filter("assoc > 0").withColumn("t_rank", F.row_number().over(wt))
            .filter(F.col("t_rank") <= top_t).select(*keys, "c", "c_rank", "w", "term", "t_rank", "assoc"))
