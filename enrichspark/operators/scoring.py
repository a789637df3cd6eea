"""Scores of ranked term predictions on propagated sets weighted by information content (IC).

Sets of ancestors are arrays: their length is bounded by the ontology. Pairs of genes and terms that
share no informative ancestor have F1 = 0 and are never formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.skew import split_join
from enrichspark.functions.draws import hash32
from enrichspark.functions.ordering import quantiles
from enrichspark.operators.ranking import keep_first
from enrichspark.session import materialize, spread

KS = (1, 3, 5, 10)
#: Rows of genes and terms that meet a copy of the drawn sets together.
FLOOR_ROWS = 1 << 16


def information_content(propagated: DataFrame) -> DataFrame:
    """(term, ic): -ln of the share of annotated genes carrying the term after propagation."""
    n = propagated.agg(F.count_distinct("gene").cast("double").alias("n")).scalar()
    counts = propagated.groupBy("term").agg(F.count("*").alias("n_genes"))
    return counts.select("term", (0.0 - F.log(F.col("n_genes") / n)).alias("ic"))


def ic_of(terms: DataFrame, ic: DataFrame, propagated: DataFrame) -> DataFrame:
    """IC of any terms; a term no gene carries gets the maximum ln(n)."""
    n = propagated.agg(F.count_distinct("gene").cast("double").alias("n")).scalar()
    return terms.join(ic, "term", "left").withColumn("ic", F.coalesce("ic", F.log(n)))


def f1(overlap: Column, predicted: Column, truth: Column) -> Column:
    """Harmonic mean of overlap/predicted and overlap/truth, 0 without overlap."""
    return F.when((overlap > 0) & (predicted > 0) & (truth > 0), 2 * overlap / (predicted + truth)).otherwise(0.0)


def truth_mass(propagated: DataFrame, ic: DataFrame) -> DataFrame:
    return propagated.join(ic, "term").groupBy("gene").agg(F.sum("ic").alias("truth_mass"))


def score_rankings(preds: DataFrame, propagated: DataFrame, closed: DataFrame, ic: DataFrame,
                   keys: list[str] | None = None, ks: tuple[int, ...] = KS, dedupe: bool = True) -> DataFrame:
    """F1@k for each ranking of preds(*keys, term, rank) and the mean of F1@1..10; keys include gene.

    An ancestor enters a prediction at the best rank of the terms below it, so one pass serves all k.
    """
    keys = keys or ["gene"]
    ranked = keep_first(preds, keys) if dedupe else preds
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("n_predictions"))
    first = (ranked.filter(F.col("rank") <= max(max(ks), 10)).join(closed, F.col("term") == F.col("src"))
             .groupBy(*keys, F.col("anc").alias("term")).agg(F.min("rank").alias("at"))
             .join(ic, "term")
             .join(propagated.select("gene", "term").withColumn("_hit", F.lit(1)), ["gene", "term"], "left"))
    mass = [F.sum(F.when(F.col("at") <= k, F.col("ic")).otherwise(0.0)).alias(f"_m{k}")
            for k in sorted(set(range(1, 11)) | set(ks))]
    over = [F.sum(F.when((F.col("at") <= k) & F.col("_hit").isNotNull(), F.col("ic")).otherwise(0.0)).alias(f"_o{k}")
            for k in sorted(set(range(1, 11)) | set(ks))]
    sums = first.groupBy(*keys).agg(*mass, *over).join(sizes, keys).join(truth_mass(propagated, ic), "gene")
    at_k = {k: f1(F.col(f"_o{k}"), F.col(f"_m{k}"), F.col("truth_mass")) for k in sorted(set(range(1, 11)) | set(ks))}
    mean = sum((at_k[k] for k in range(2, 11)), at_k[1]) / 10
    return sums.select(*keys, "n_predictions", "truth_mass", *[at_k[k].alias(f"f1_at_{k}") for k in ks],
                       mean.alias("f1_mean_1_10"))


def score_both_rankings(by_p: DataFrame, by_effect: DataFrame, propagated: DataFrame, closed: DataFrame,
                        ic: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the p and the effect ranking in one pass, under a ranking column."""
    both = (by_p.withColumn("ranking", F.lit("p")).unionByName(by_effect.withColumn("ranking", F.lit("effect"))))
    return score_rankings(both, propagated, closed, ic, ["ranking"] + keys)


def significant_only_score(preds: DataFrame, significant: DataFrame, propagated: DataFrame, closed: DataFrame,
                           ic: DataFrame, keys: list[str]) -> DataFrame:
    """Score of the same ranking cut to significant terms; genes with none are absent, not 0."""
    return score_rankings(preds.join(significant.select(*keys, "term"), keys + ["term"], "left_semi"),
                          propagated, closed, ic, keys)


def _mass(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x["ic"])


def reachable_sets(vocabulary: DataFrame, closed: DataFrame, ic: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, term, anc_set): informative ancestors of each vocabulary term with their IC."""
    return (vocabulary.select(*keys, "term").join(closed, F.col("term") == F.col("src"))
            .join(ic.filter("ic > 0").select(F.col("term").alias("anc"), "ic"), "anc")
            .groupBy(*keys, "term").agg(F.array_sort(F.collect_list(F.struct("anc", "ic"))).alias("anc_set")))


def ceilings(propagated: DataFrame, vocabulary: DataFrame, closed: DataFrame, ic: DataFrame,
             keys: list[str] | None = None) -> DataFrame:
    """Best F1 of one and of up to three vocabulary terms, the mean over single terms, and what is reachable.

    keys name columns of `vocabulary` that tell several vocabularies apart. The three-term
    ceiling is greedy: a term is added only if it raises F1; among equals the smallest id wins.
    """
    keys = keys or []
    sets = materialize(reachable_sets(vocabulary, closed, ic, keys), "sets")
    size = vocabulary.groupBy(*keys).agg(F.count_distinct("term").alias("n_vocab"))
    masses = truth_mass(propagated, ic)
    pairs = sets.select(*keys, F.col("term").alias("v"), F.explode("anc_set").alias("x"))
    # genes are dealt first: the few vocabularies are repeated to them, and the steps that follow stay where a gene is
    own = spread(propagated.select("gene", F.col("term").alias("t")), "gene", rows=propagated.count() * (size.count() if keys else 1))
    shared = (split_join(own, pairs.withColumn("t", F.col("x.anc")), ["t"], "t", source=propagated.select(F.col("term").alias("t")))
              .groupBy(*keys, "gene", "v").agg(F.array_sort(F.collect_list("x")).alias("hits")))
    gv = (shared.join(sets.withColumnRenamed("term", "v"), keys + ["v"]).join(masses, "gene")
          .withColumn("overlap", _mass(F.col("hits"))).withColumn("mass", _mass(F.col("anc_set")))
          .withColumn("f", f1(F.col("overlap"), F.col("mass"), F.col("truth_mass"))))
    gene = Window.partitionBy(*keys, "gene")

    def best(f: str):
        pick = F.struct(F.round(-F.col(f), 10).alias("o"), F.col("v"), F.col(f).alias("f"), "overlap", "mass", "anc_set")
        return F.min(pick).over(gene)

    one = gv.withColumn("_1", best("f")).withColumn("f_single", F.col("f"))
    state = one.withColumn("_have", F.col("_1.anc_set")).withColumn("_f", F.col("_1.f")) \
               .withColumn("_ov", F.col("_1.overlap")).withColumn("_ms", F.col("_1.mass"))
    for _ in range(2):
        state = (state.withColumn("_no", F.col("_ov") + _mass(F.array_except("hits", "_have")))
                 .withColumn("_nm", F.col("_ms") + _mass(F.array_except("anc_set", "_have")))
                 .withColumn("_nf", f1(F.col("_no"), F.col("_nm"), F.col("truth_mass"))))
        pick = F.min(F.struct(F.round(-F.col("_nf"), 10).alias("o"), F.col("v"), F.col("_nf").alias("f"),
                              F.col("_no").alias("ov"), F.col("_nm").alias("ms"), "anc_set")).over(gene)
        state = state.withColumn("_b", pick)
        better = F.col("_b.f") > F.col("_f") + 1e-12
        # once a round brings nothing, later rounds see the same state and bring nothing either
        state = (state.withColumn("_ov", F.when(better, F.col("_b.ov")).otherwise(F.col("_ov")))
                 .withColumn("_ms", F.when(better, F.col("_b.ms")).otherwise(F.col("_ms")))
                 .withColumn("_have", F.when(better, F.array_union("_have", "_b.anc_set")).otherwise(F.col("_have")))
                 .withColumn("_f", F.when(better, F.col("_b.f")).otherwise(F.col("_f"))).drop("_b"))
    per_gene = state.groupBy(*keys, "gene").agg(
        F.max("f_single").alias("f1_top1"), F.sum("f_single").alias("_sum"), F.max("_f").alias("f1_top3"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("_reach"))
    n_vocab = _attach(masses, size, keys)
    return (n_vocab.join(per_gene, keys + ["gene"], "left")
            .select(*keys, "gene", "truth_mass",
                    F.when(F.col("truth_mass") > 0, F.coalesce(_mass(F.col("_reach")) / F.col("truth_mass"), F.lit(0.0)))
                    .otherwise(0.0).alias("reachable_ic_fraction"),
                    F.coalesce(F.array_max(F.transform("_reach", lambda x: x["ic"])), F.lit(0.0)).alias("max_shared_ic"),
                    F.coalesce("f1_top1", F.lit(0.0)).alias("f1_top1"),
                    F.coalesce(F.col("_sum") / F.col("n_vocab"), F.lit(0.0)).alias("f1_top1_random"),
                    F.coalesce("f1_top3", F.lit(0.0)).alias("f1_top3")))


def _attach(genes: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat genes once per vocabulary; the number of vocabularies is a parameter."""
    every = sizes.agg(F.collect_list(F.struct(*sizes.columns)).alias("v")).scalar()
    return genes.withColumn("_v", F.explode(every)).select(*genes.columns, "_v.*")


def random_term_sets(vocabulary: DataFrame, k: int, n_draws: int, seed: int) -> DataFrame:
    """(draw, term): k distinct vocabulary terms per draw, in hash order."""
    draws = vocabulary.select("term").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    w = Window.partitionBy("draw").orderBy(hash32(seed, "draw", F.col("draw"), F.col("term")), "term")
    return draws.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("draw", "term")


def floor_at_k(propagated: DataFrame, vocabulary: DataFrame, closed: DataFrame, ic: DataFrame, k: int = 3,
               n_draws: int = 500, seed: int = 0) -> DataFrame:
    """(gene, floor): mean F1 of k random vocabulary terms over n_draws draws.

    Genes are dealt into blocks by their rows and each block meets all drawn sets, which n_draws and the ontology bound.
    """
    drawn = materialize(random_term_sets(vocabulary, k, n_draws, seed).join(closed, F.col("term") == F.col("src"))
                        .join(ic.filter("ic > 0").select(F.col("term").alias("anc"), "ic"), "anc").select("draw", "anc", "ic").distinct(), "drawn")
    genes = (propagated.join(ic, "term").groupBy("gene")
             .agg(F.sum("ic").alias("truth_mass"), F.collect_set(F.when(F.col("ic") > 0, F.col("term"))).alias("own")))
    blocks = -(-propagated.count() // FLOOR_ROWS) or 1
    dealt = genes.withColumn("block", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    copies = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (spread(dealt, "block").groupBy("block").cogroup(spread(copies, "block").groupBy("block"))
            .applyInArrow(_floors(n_draws), f"gene {propagated.schema['gene'].dataType.simpleString()}, floor double"))


def _floors(n_draws: int):
    """Floors of genes(gene, truth_mass, own) from drawn(draw, anc, ic); null without drawn sets."""
    def run(genes: pa.Table, drawn: pa.Table) -> pa.Table:
        floors = [None] * genes.num_rows
        if genes.num_rows and drawn.num_rows:
            terms, row = np.unique(drawn["anc"].to_numpy(), return_inverse=True)
            draws, column = np.unique(drawn["draw"].to_numpy(), return_inverse=True)
            held = np.zeros((len(terms), len(draws)))
            held[row, column] = drawn["ic"].to_numpy()
            mass, at = held.sum(axis=0), {t: i for i, t in enumerate(terms.tolist())}
            for i, (truth, own) in enumerate(zip(genes["truth_mass"].to_pylist(), genes["own"].to_pylist())):
                overlap = held[[at[t] for t in own if t in at]].sum(axis=0)
                floors[i] = float(np.divide(2 * overlap, mass + truth, out=np.zeros(len(mass)), where=overlap > 0).sum() / n_draws)
        return pa.table({"gene": genes["gene"], "floor": pa.array(floors, pa.float64())})
    return run


def headroom(scores: DataFrame, floors: DataFrame, tops: DataFrame, k: int) -> DataFrame:
    """(F1@k - floor) / (ceiling - floor); null where there is no room."""
    gap = F.col("ceiling") - F.col("floor")
    return (scores.join(floors, "gene").join(tops, "gene")
            .withColumn(f"headroom_at_{k}", F.when(gap > 1e-9, (F.col(f"f1_at_{k}") - F.col("floor")) / gap)))


def constant_prior(propagated: DataFrame, dev: DataFrame, vocabulary: DataFrame, closed: DataFrame, ic: DataFrame,
                   k: int = 3) -> DataFrame:
    """(rank, term): the fixed list that maximises mean F1 over the development genes, chosen greedily.

    F1 is linear in the overlap once the predicted mass is known, so a term's score is the gain over its postings (the genes
    that carry an ancestor it would newly cover) plus what the list so far gives at that mass. The latter falls with the mass and
    is convex in it: sums at fixed points bound it for every term, and only terms that can still win are summed
    exactly. After a pick only genes and postings with a newly covered ancestor change. Among equals the smallest id wins.
    """
    spark = propagated.sparkSession
    reach = materialize(vocabulary.select("term").distinct().join(closed.select(F.col("src").alias("term"), "anc").distinct(), "term")
                        .join(ic.filter("ic > 0").select(F.col("term").alias("anc"), "ic"), "anc"), "reach")
    own = materialize(propagated.join(dev.select("gene").distinct(), "gene", "left_semi").join(ic, "term")
                      .select("gene", F.col("term").alias("anc"), "ic"), "own")
    genes = materialize(own.groupBy("gene").agg(F.sum("ic").alias("truth_mass"), F.lit(0.0).alias("overlap")), "genes")
    n = max(genes.count(), 1)
    postings = materialize(split_join(own.select("gene", "anc"), reach, ["anc"], "anc", source=own.select("anc")).groupBy("term", "gene")
                           .agg(F.sum("ic").alias("gain")).join(genes.select("gene", "truth_mass"), "gene"), "postings")
    chosen, covered, best = [], 0.0, -1.0
    for _ in range(k):
        mass = reach.groupBy("term").agg(F.sum("ic").alias("mass"))
        won = (postings.join(mass, "term").groupBy("term")
               .agg(F.sum(2 * F.col("gain") / (covered + F.col("mass") + F.col("truth_mass"))).alias("won")))
        scored = mass.join(won, "term", "left").select("term", "mass", (F.coalesce("won", F.lit(0.0)) / n).alias("score"))
        if chosen:
            scored = _with_kept(materialize(scored, "scored"), genes.filter("overlap > 0"), covered, n)
        top = scored.orderBy(F.round("score", 10).desc(), "term").first()
        if top is None or top["score"] <= best + 1e-12:
            break
        best, covered = top["score"], covered + top["mass"]
        chosen.append(top["term"])
        if len(chosen) < k:
            pick = F.col("term") == F.lit(top["term"])
            newly = reach.filter(pick).select("anc")
            gained = postings.filter(pick).select("gene", "gain")
            # genes without a gain carry none of the newly covered ancestors, so their postings stay as they are
            shared = own.join(gained.select("gene"), "gene", "left_semi").join(newly, "anc", "left_semi").select("gene", "anc")
            lost = split_join(shared, reach, ["anc"], "anc", source=own.select("anc")).groupBy("term", "gene").agg(F.sum("ic").alias("lost"))
            genes, postings, reach = (
                materialize(genes.join(gained, "gene", "left").select("gene", "truth_mass", (F.col("overlap") + F.coalesce("gain", F.lit(0.0))).alias("overlap")), "genes"),
                materialize(postings.join(lost, ["term", "gene"], "left").withColumn("gain", F.col("gain") - F.coalesce("lost", F.lit(0.0)))
                            .filter("gain > 1e-12").drop("lost"), "postings"),
                materialize(reach.join(newly, "anc", "left_anti"), "reach"))
    term_type = vocabulary.schema["term"].dataType.simpleString()
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(chosen)], f"rank int, term {term_type}")


def _with_kept(scored: DataFrame, genes: DataFrame, covered: float, n: int, points: int = 16) -> DataFrame:
    """scored(term, mass, score) of the terms that may come first, with the mean F1 of genes(truth_mass, overlap) at their mass added."""
    width = scored.agg(F.max("mass")).first()[0]
    if width is None:
        return scored

    def kept(x: Column) -> Column:
        return F.coalesce(F.sum(2 * F.col("overlap") / (covered + x + F.col("truth_mass"))), F.lit(0.0)) / n
    grid = genes.agg(F.array(*[kept(F.lit(width * i / points)) for i in range(points + 1)]).alias("y")).first()["y"]
    at = F.col("mass") / width * points
    cell = F.least(F.floor(at), F.lit(points - 1)).cast("int")
    y = F.array(*[F.lit(v) for v in grid])
    left, right = F.get(y, cell), F.get(y, cell + 1)
    bounded = scored.withColumns({"_low": F.col("score") + right, "_high": F.col("score") + left + (right - left) * (at - cell)})
    bar = bounded.agg(F.max("_low")).first()[0]
    able = bounded.filter(F.col("_high") >= bar - 1e-9).select("term", "mass", "score")
    masses = able.agg(F.collect_set("mass")).scalar()
    exact = genes.select("overlap", "truth_mass", F.explode(masses).alias("mass")).groupBy("mass").agg(kept(F.col("mass")).alias("_kept"))
    return able.join(exact, "mass", "left").select("term", "mass", (F.col("score") + F.coalesce("_kept", F.lit(0.0))).alias("score"))


def matched_random_vocabularies(vocabulary: DataFrame, pool: DataFrame, n_draws: int, seed: int,
                                tolerance: float = 0.25) -> DataFrame:
    """(draw, term): for each vocabulary term a random pool term of similar IC, without reuse in a draw.

    vocabulary and pool are (term, ic), both bounded by the ontology. Terms are served in id order.
    """
    width = F.floor(F.col("ic") / tolerance)
    near = (vocabulary.select(F.col("term").alias("v"), F.col("ic").alias("v_ic"),
                              F.explode(F.array(width - 1, width, width + 1)).alias("cell"))
            .join(pool.select("term", "ic", width.alias("cell")), "cell")
            .filter(F.abs(F.col("ic") - F.col("v_ic")) <= tolerance).select("v", "term"))
    drawn = near.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    key = hash32(seed, "null", F.col("draw"), F.col("v"), F.col("term"))
    lists = (drawn.groupBy("draw", "v")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("h"), "term"))), lambda x: x["term"])
                  .alias("options"))
             .groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("v", "options"))).alias("turns")))
    kind = pool.schema["term"].dataType.simpleString()
    picked = F.aggregate("turns", F.array().cast(f"array<{kind}>"), lambda used, turn: F.concat(
        used, F.slice(F.filter(turn["options"], lambda t: ~F.array_contains(used, t)), 1, 1)))
    return lists.select("draw", F.explode(picked).alias("term"))


def summarize(values: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles, mean and share above 0 of each column over all genes, one row per metric."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]
    long = values.select(F.explode(F.create_map(*pairs)).alias("metric", "value"))
    q = quantiles(long, "value", {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}, ["metric"])
    means = long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                       F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("frac_gt_0"))
    return q.join(means, "metric")
