"""Profiles of predictions by gene, term and match kind: the tables behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.ordering import average_ranks, cumulative, quantiles
from enrichspark.operators.matching import KINDS

# fixed values: evidence codes that stand for a measurement
EXPERIMENTAL_EVIDENCE = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "HTP", "HDA", "HMP", "HGI", "HEP")

MATCHED = ("exact", "upward", "downward")


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def tissue_purity(carriers: DataFrame, items: DataFrame) -> DataFrame:
    """Per term: largest tissue among its rows, tissues covered, normalised entropy, the tissue's share of all annotated rows."""
    rows = carriers.select("ct", "term").join(items, "ct")
    per = rows.groupBy("term", "tissue").agg(F.count("*").alias("n"))
    total = per.withColumn("_all", F.sum("n").over(Window.partitionBy("term")))  # one row per tissue
    p = F.col("n") / F.col("_all")
    out = total.groupBy("term").agg(
        F.count("*").alias("n_tissues"), F.min_by("tissue", F.struct((-F.col("n")).alias("o"), "tissue")).alias("top_tissue"),
        F.max(p).alias("top_tissue_share"), (-F.sum(p * F.log(p))).alias("_h"))
    annotated = items.join(carriers.select("ct").distinct(), "ct", "left_semi")
    overall = annotated.groupBy(F.col("tissue").alias("top_tissue")).agg(F.count("*").alias("_t"))
    n_all = annotated.agg(F.count("*").alias("n")).scalar()
    return (out.join(overall, "top_tissue", "left")
            .withColumn("entropy_normalized", F.when(F.col("n_tissues") > 1, F.col("_h") / F.log(F.col("n_tissues").cast("double"))).otherwise(0.0))
            .withColumn("top_tissue_share_of_all_rows", F.col("_t") / n_all).drop("_h", "_t"))


def term_profile(every: DataFrame, assigned: DataFrame, carriers: DataFrame, items: DataFrame) -> DataFrame:
    """Per term: carriers, assigned genes by match kind, precision, base match rate and lift.

    every is (gene, term, kind) over the whole vocabulary, assigned (gene, term, kind) the significant part of it.
    """
    base = every.groupBy("term").agg(F.count("*").alias("n_genes"), _share(F.col("kind") != "no_match").alias("base_match_rate"),
                                     *[_share(F.col("kind") == k).alias(f"base_{k}") for k in MATCHED])
    got = assigned.groupBy("term").agg(F.count("*").alias("assigned"),
                                       *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    size = carriers.groupBy("term").agg(F.count_distinct("ct").alias("k_ct"))
    rows = carriers.join(items, "ct").groupBy("term").agg(F.count_distinct("item").alias("k_row"))
    counts = ["assigned"] + [f"n_{k}" for k in KINDS]
    matches = F.col("n_exact") + F.col("n_upward") + F.col("n_downward")
    return (base.join(got, "term", "left").fillna(0, counts).join(size, "term").join(rows, "term")
            .withColumn("precision", F.when(F.col("assigned") > 0, matches / F.col("assigned")))
            .withColumn("lift", F.when(F.col("base_match_rate") > 0, F.col("precision") / F.col("base_match_rate"))))


def assigned_breadth(assigned: DataFrame, breadth: DataFrame) -> DataFrame:
    """Mean and median breadth of the genes assigned to each term; a term may hold any share of the genes."""
    rows = assigned.select("gene", "term").join(breadth, "gene").filter(F.col("breadth").isNotNull())
    return (rows.groupBy("term").agg(F.avg("breadth").alias("mean_breadth"))
            .join(quantiles(rows, "breadth", {"median_breadth": 0.5}, ["term"]), "term"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns with tied values sharing their mean rank."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def jaccard_pairs(held: DataFrame, member: str) -> DataFrame:
    """(term_a, term_b, n_common, jaccard) of term pairs sharing at least one member; other pairs have Jaccard 0.

    A member contributes pairs of its own terms, whose number is bounded by the vocabulary.
    """
    h = held.select(F.col(member).alias("m"), "term").distinct()
    sizes = h.groupBy("term").agg(F.count("*").alias("n"))
    own = h.groupBy("m").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    a = own.select("ts", F.posexplode("ts").alias("i", "term_a"))
    pairs = a.select("term_a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("term_b"))
    common = pairs.groupBy("term_a", "term_b").agg(F.count("*").alias("n_common"))
    return (common.join(sizes.select(F.col("term").alias("term_a"), F.col("n").alias("_na")), "term_a")
            .join(sizes.select(F.col("term").alias("term_b"), F.col("n").alias("_nb")), "term_b")
            .withColumn("jaccard", F.col("n_common") / (F.col("_na") + F.col("_nb") - F.col("n_common"))).drop("_na", "_nb"))


def family_enrichment(assigned: DataFrame, families: DataFrame, look: int = 5, keep: int = 3) -> DataFrame:
    """Per term: the most common families among its genes against their share of all genes.

    The `look` most common are taken first, genes without a family are dropped then, and `keep` remain.
    """
    n_all = families.agg(F.count("*").alias("n")).scalar()
    overall = families.groupBy("family").agg(F.count("*").alias("_f"))
    rows = assigned.select("gene", "term").distinct().join(families, "gene")
    n = rows.groupBy("term").agg(F.count("*").alias("_n"))
    per = rows.groupBy("term", "family").agg(F.count("*").alias("c"))
    w = Window.partitionBy("term").orderBy(F.desc("c"), F.col("family").asc_nulls_last())
    first = per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= look).filter(F.col("family").isNotNull())
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("_r"))).filter(F.col("rank") <= keep)
    return (kept.join(n, "term").join(overall, "family")
            .select("term", "rank", "family", (F.col("c") / F.col("_n")).alias("share_assigned"),
                    (F.col("_f") / n_all).alias("share_all"),
                    (F.col("c") / F.col("_n") / (F.col("_f") / n_all)).alias("enrichment")))


def term_properties(classified: DataFrame, truths_with_codes: DataFrame, closed: DataFrame, ic: DataFrame,
                    experimental: tuple[str, ...] = EXPERIMENTAL_EVIDENCE) -> DataFrame:
    """Per prediction: IC, IC gap to its matched true term, evidence codes of all related true terms.

    classified is (gene, term, kind, matched_term, ...); truths_with_codes (gene, term, codes). The gap is
    the true term's IC minus the prediction's: positive when the prediction is broader.
    """
    true_id = F.when(F.col("kind") == "exact", F.col("term")).otherwise(F.col("matched_term"))
    rows = (classified.withColumn("true_term", true_id).join(ic, "term", "left")
            .join(ic.select(F.col("term").alias("true_term"), F.col("ic").alias("ic_true")), "true_term", "left"))
    codes = truths_with_codes.select("gene", F.col("term").alias("_t"), "codes")
    keyed = classified.select("gene", "term", "kind")
    exact = keyed.filter("kind = 'exact'").join(codes.withColumnRenamed("_t", "term"), ["gene", "term"])
    strict = closed.filter("depth > 0")
    up = (keyed.filter("kind = 'upward'").join(strict, F.col("term") == F.col("anc"))
          .join(codes.withColumnRenamed("_t", "src"), ["gene", "src"]))
    down = (keyed.filter("kind = 'downward'").join(strict, F.col("term") == F.col("src"))
            .join(codes.withColumnRenamed("_t", "anc"), ["gene", "anc"]))
    seen = (exact.select("gene", "term", "codes").unionByName(up.select("gene", "term", "codes"))
            .unionByName(down.select("gene", "term", "codes"))
            .groupBy("gene", "term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes")))
    wanted = F.array(*[F.lit(c) for c in experimental])
    return (rows.join(seen, ["gene", "term"], "left").withColumn("ic_gap", F.col("ic_true") - F.col("ic"))
            .withColumn("experimental", F.arrays_overlap("codes", wanted)))


def evidence_strength(properties: DataFrame) -> DataFrame:
    """Matches backed by a measurement and those that are not."""
    return properties.filter(F.col("kind") != "no_match").groupBy("experimental").agg(F.count("*").alias("n"))


def gene_properties(summary: DataFrame, matches: DataFrame, homogeneity: DataFrame, tops: DataFrame,
                    families: DataFrame) -> DataFrame:
    """One row per gene: breadth, match counts, tissue homogeneity, ceiling and family."""
    return (summary.select("gene", "n_positive", "n_total", (F.col("n_positive") / F.col("n_total")).alias("breadth"))
            .join(matches, "gene", "left").join(homogeneity.select("gene", "frac_flagged"), "gene", "left")
            .join(tops.select("gene", "f1_top1"), "gene", "left").join(families, "gene", "left"))


def gene_table(genes: DataFrame, first: DataFrame, second: DataFrame, answers: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Per gene and arm: predictions by kind, match_at_k, exact_at_k, any_match and any_exact; n_duplicate of its answers.

    Each arm is (gene, rank, kind), answers is (gene, n_raw, n_valid, n_invalid) with one row a gene; what is neither valid nor invalid is a
    repeat, never less than 0. Genes without predictions or answers get 0.
    """
    out = genes.select("gene")
    for name, arm in (("first", first), ("second", second)):
        match, exact = F.col("kind") != "no_match", F.col("kind") == "exact"
        flags = [F.max(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"{name}_{word}_at_{k}") for word, hit in (("match", match), ("exact", exact)) for k in ks]
        flags += [F.max(F.when(hit, 1).otherwise(0)).alias(f"{name}_any_{word}") for word, hit in (("match", match), ("exact", exact))]
        kinds = [F.count_if(F.col("kind") == k).alias(f"{name}_n_{k}") for k in ("exact", "upward", "downward", "no_match")]
        out = out.join(arm.groupBy("gene").agg(F.count("*").alias(f"{name}_n"), *kinds, *flags), "gene", "left")
    repeats = answers.select("gene", F.greatest(F.col("n_raw") - F.col("n_valid") - F.col("n_invalid"), F.lit(0)).alias("n_duplicate"))
    return out.join(repeats, "gene", "left").fillna(0)


def funnel(per_gene: DataFrame) -> DataFrame:
    """Genes, genes with any prediction, with any match, with an exact match; per_gene has n_<kind> counts."""
    match = F.col("n_exact") + F.col("n_upward") + F.col("n_downward")
    return per_gene.agg(F.count("*").alias("genes"), F.count_if(match + F.col("n_no_match") > 0).alias("any_term"),
                        F.count_if(match > 0).alias("any_match"), F.count_if(F.col("n_exact") > 0).alias("any_exact"))


def rate_by(rows: DataFrame, bin_column: Column, flag: str) -> DataFrame:
    """Rows, hits and rate per bin."""
    hit = F.col(flag).cast("int")
    return rows.groupBy(bin_column.alias("bin")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("rate"))


def decile_bin(x: Column, width: float = 0.1) -> Column:
    """Fixed bins (0, 0.1], (0.1, 0.2] ... numbered from 0, the first closed on both sides."""
    n = round(1 / width)
    return F.least(F.greatest(F.ceil(F.round(x * n, 9)) - 1, F.lit(0)), F.lit(n - 1)).cast("int")


def richness_bin(n: Column) -> Column:
    return (F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank == 2, "2").otherwise("3+")


def confidence_bin(x: Column, edges: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> Column:
    """Number of the bin (edge i-1, edge i], the last one open to the right."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x <= edges[i], i).otherwise(out)
    return F.when(x.isNotNull(), out)


def concentration(preds: DataFrame, label: str) -> DataFrame:
    """Labels by frequency with share and cumulative share of all predictions."""
    counts = preds.groupBy(label).agg(F.count("*").alias("n")).withColumn("_o", -F.col("n"))
    cum = cumulative(counts, ["_o", label], ["n"])
    return cum.select(label, "n", (F.col("n") / F.col("n_total")).alias("share"),
                      (F.col("n_upto") / F.col("n_total")).alias("cumulative_share"))


def top_labels(classified: DataFrame, n: int = 20) -> DataFrame:
    """The n most predicted terms with the share of each match kind among their predictions."""
    per = classified.groupBy("term").agg(F.count("*").alias("n"), *[_share(F.col("kind") == k).alias(f"share_{k}") for k in KINDS])
    return per.orderBy(F.desc("n"), "term").limit(n)


def pair_table(properties: DataFrame) -> DataFrame:
    """(prediction, true term): matches, median IC distance and median edges."""
    rows = (properties.filter(F.col("kind").isin("upward", "downward"))
            .select("term", "true_term", F.abs("ic_gap").alias("gap"), F.col("distance").cast("double").alias("distance")))
    keys = ["term", "true_term"]
    return (rows.groupBy(*keys).agg(F.count("*").alias("n"))
            .join(quantiles(rows, "gap", {"median_gap": 0.5}, keys), keys)
            .join(quantiles(rows, "distance", {"median_edges": 0.5}, keys), keys))


def by_true_term(properties: DataFrame) -> DataFrame:
    """Matches and distinct genes per true term."""
    return (properties.filter(F.col("true_term").isNotNull()).groupBy("true_term")
            .agg(F.count("*").alias("n_matches"), F.count_distinct("gene").alias("n_genes")))


def empirical_distribution(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """Cumulative share of flagged and of all rows up to each distinct value."""
    per = (rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value"))
           .agg(F.count("*").alias("n_all"), F.count_if(flag).alias("n_hit")))
    c = cumulative(per, ["value"], ["n_all", "n_hit"])
    return c.select("value", (F.col("n_all_upto") / F.col("n_all_total")).alias("cdf_all"),
                    (F.col("n_hit_upto") / F.greatest(F.col("n_hit_total"), F.lit(1))).alias("cdf_hit"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both, only one or neither of two flags hold."""
    cell = (F.when(F.col(a) & F.col(b), "both").when(F.col(a), f"only_{a}").when(F.col(b), f"only_{b}").otherwise("neither"))
    return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def observed_vs_expected(matches: DataFrame, chance: DataFrame) -> DataFrame:
    """Matches of each kind against the number expected by chance, summed over genes."""
    n = F.col("n_exact") + F.col("n_upward") + F.col("n_downward") + F.col("n_no_match")
    rows = matches.join(chance, "gene").withColumn("_n", n)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").cast("double").alias("o"),
                                         (F.col("_n") * F.col(f"chance_{k}")).alias("e")) for k in MATCHED])).alias("x")
    return (rows.select(kinds).groupBy("x.kind").agg(F.sum("x.o").alias("observed"), F.sum("x.e").alias("expected"))
            .withColumn("ratio", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected"))))


def copied_vs_added(classified: DataFrame, table: DataFrame) -> DataFrame:
    """Match rate of predictions that repeat an evidence term and of those that do not."""
    shown = table.select("gene", "term").distinct().withColumn("_in", F.lit(True))
    rows = classified.join(shown, ["gene", "term"], "left").withColumn("in_table", F.coalesce("_in", F.lit(False)))
    return rows.groupBy("in_table").agg(F.count("*").alias("n"), _share(F.col("kind") != "no_match").alias("match_rate"))
