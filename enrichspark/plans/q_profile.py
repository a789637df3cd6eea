"""Report tables over classified predictions."""

from pyspark.sql import functions as F

from enrichspark.operators import annotations, coverage, enrichment, matching, matrix, profile, ranking, transfer
from enrichspark.operators.vocabulary import with_every_term
from enrichspark.plans.q_compare import universe
from enrichspark.plans.q_stats import rank_ora
from enrichspark.plans.q_score import assoc, chance, classify_sql, match_genes, matched, model_ceilings, predictions
from enrichspark.plans.registry import query, rounded, stable_p
from enrichspark.plans.sql import fragment


@query("tissue_purity", """
WITH per AS (SELECT term, tissue, count(*) n FROM t_carriers JOIN t_items USING (ct) GROUP BY 1, 2),
p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY term) AS DOUBLE) s FROM per),
o AS (SELECT term, count(*) n_tissues, arg_min(tissue, (-n, tissue)) top_tissue, max(s) top_tissue_share, -sum(s * ln(s)) h FROM p GROUP BY 1)
SELECT CAST(term AS BIGINT) term, n_tissues, top_tissue, round(top_tissue_share, 6) top_tissue_share,
  round(CASE WHEN n_tissues > 1 THEN h / ln(n_tissues) ELSE 0 END, 6) entropy_normalized,
  round((SELECT count(*) FROM t_items i WHERE i.tissue = o.top_tissue) / CAST((SELECT count(*) FROM t_items) AS DOUBLE), 6) top_tissue_share_of_all_rows
FROM o""")
def _(m):
    return rounded(profile.tissue_purity(m.carriers, m.items))


fragment("t_assigned", """
SELECT gene, term, min(rank) rank FROM t_rank_ora SEMI JOIN (SELECT * FROM t_gscs WHERE significant) USING (unit, gene, term) GROUP BY 1, 2""")
fragment("t_assigned_match", classify_sql("SELECT gene, term FROM t_assigned", "gene"))


def assigned(m):
    """Candidate terms significant for a gene at either unit."""
    sig = m.tested.filter("significant").select("gene", "term").distinct().join(m.vocabulary, "term", "left_semi")
    return matching.classify(sig.join(m.truths.select("gene").distinct(), "gene", "left_semi"), m.truths, m.closed)


@query("term_profile", """
WITH base AS (SELECT term, count(*) n_genes, avg(CASE WHEN kind <> 'no_match' THEN 1.0 ELSE 0.0 END) bm,
    avg(CASE WHEN kind = 'exact' THEN 1.0 ELSE 0.0 END) be, avg(CASE WHEN kind = 'upward' THEN 1.0 ELSE 0.0 END) bu,
    avg(CASE WHEN kind = 'downward' THEN 1.0 ELSE 0.0 END) bd FROM t_chance_match GROUP BY 1),
got AS (SELECT term, count(*) assigned, count(*) FILTER (kind = 'exact') n_exact, count(*) FILTER (kind = 'upward') n_upward,
    count(*) FILTER (kind = 'downward') n_downward, count(*) FILTER (kind = 'no_match') n_no_match FROM t_assigned_match
    WHERE gene IN (SELECT gene FROM t_truth) GROUP BY 1)
SELECT CAST(term AS BIGINT) term, n_genes, round(bm, 6) base_match_rate, round(be, 6) base_exact, round(bu, 6) base_upward,
  round(bd, 6) base_downward, coalesce(assigned, 0) assigned, coalesce(n_exact, 0) n_exact, coalesce(n_upward, 0) n_upward,
  coalesce(n_downward, 0) n_downward, coalesce(n_no_match, 0) n_no_match,
  (SELECT count(DISTINCT ct) FROM t_carriers c WHERE c.term = b.term) k_ct,
  (SELECT count(DISTINCT item) FROM t_carriers c JOIN t_items USING (ct) WHERE c.term = b.term) k_row,
  round((n_exact + n_upward + n_downward) / CAST(assigned AS DOUBLE), 6) AS precision,
  round((n_exact + n_upward + n_downward) / CAST(assigned AS DOUBLE) / nullif(bm, 0), 6) lift
FROM base b LEFT JOIN got USING (term)""")
def _(m):
    every = matching.classify(with_every_term(m.truths.select("gene").distinct(), m.vocabulary), m.truths, m.closed)
    return rounded(profile.term_profile(every, assigned(m), m.carriers, m.items))


@query("assigned_breadth", """
SELECT CAST(term AS BIGINT) term, round(avg(b), 6) mean_breadth, round(quantile_cont(b, 0.5), 6) median_breadth
FROM t_assigned_match JOIN (SELECT gene, n_pos / CAST(n_called AS DOUBLE) b FROM t_rates WHERE unit = 'rows') USING (gene)
WHERE gene IN (SELECT gene FROM t_truth) GROUP BY 1""")
def _(m):
    b = m.rates.filter("unit = 'rows'").select("gene", F.col("rate").alias("breadth"))
    return rounded(profile.assigned_breadth(assigned(m), b))


@query("spearman", """
SELECT round(corr(ra, rb), 6) spearman, count(*) n FROM (
  SELECT rank() OVER (ORDER BY n_direct_terms) + (count(*) OVER (PARTITION BY n_direct_terms) - 1) / 2.0 ra,
    rank() OVER (ORDER BY f1_top1) + (count(*) OVER (PARTITION BY f1_top1) - 1) / 2.0 rb FROM c_universe WHERE f1_top1 IS NOT NULL)""")
def _(m):
    return rounded(profile.spearman(universe(m), "n_direct_terms", "f1_top1"))


def _pairs_sql(source: str, member: str) -> str:
    return f"""
WITH h AS (SELECT DISTINCT {member} mm, term FROM ({source})), n AS (SELECT term, count(*) n FROM h GROUP BY 1)
SELECT CAST(term_a AS BIGINT) term_a, CAST(term_b AS BIGINT) term_b, c n_common, round(c / CAST(x.n + y.n - c AS DOUBLE), 6) jaccard
FROM (SELECT a.term term_a, b.term term_b, count(*) c FROM h a JOIN h b ON a.mm = b.mm AND a.term < b.term GROUP BY 1, 2)
JOIN n x ON x.term = term_a JOIN n y ON y.term = term_b"""


@query("jaccard_assigned_genes", _pairs_sql("SELECT gene, term FROM t_assigned", "gene"))
def _(m):
    sig = m.tested.filter("significant").select("gene", "term").distinct().join(m.vocabulary, "term", "left_semi")
    return rounded(profile.jaccard_pairs(sig, "gene"))


@query("jaccard_annotated_genes", _pairs_sql("SELECT gene, term FROM t_truth", "gene"))
def _(m):
    return rounded(profile.jaccard_pairs(m.truths, "gene"))


fragment("s_family", "SELECT s_suppkey gene, CASE WHEN s_nationkey % 5 > 0 THEN 'N' || (s_nationkey % 5) END family FROM supplier")


def families(m):
    n = F.col("s_nationkey") % 5
    return m.table("supplier").select(F.col("s_suppkey").alias("gene"), F.when(n > 0, F.concat(F.lit("N"), n)).alias("family"))


@query("family_enrichment", """
WITH r AS (SELECT term, family, gene FROM (SELECT DISTINCT gene, term FROM t_truth) JOIN s_family USING (gene)),
f AS (SELECT term, family, count(*) c, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, family NULLS LAST) r0 FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY r0) AS rank FROM f WHERE r0 <= 5 AND family IS NOT NULL)
SELECT CAST(k.term AS BIGINT) term, rank, k.family, round(c / CAST(n AS DOUBLE), 6) share_assigned,
  round(fa / CAST((SELECT count(*) FROM s_family) AS DOUBLE), 6) share_all,
  round((c / CAST(n AS DOUBLE)) / (fa / CAST((SELECT count(*) FROM s_family) AS DOUBLE)), 6) enrichment
FROM k JOIN (SELECT term, count(*) n FROM r GROUP BY 1) USING (term) JOIN (SELECT family, count(*) fa FROM s_family GROUP BY 1) USING (family)
WHERE rank <= 3""")
def _(m):
    return rounded(profile.family_enrichment(m.truths, families(m)))


# -- predictions with properties
fragment("t_codes", "SELECT gene, term, list_sort(list(DISTINCT evidence)) codes FROM t_ann WHERE evidence <> 'R' GROUP BY 1, 2")
fragment("t_props", """
SELECT p.gene, p.term, kind, distance, CASE WHEN kind = 'exact' THEN p.term ELSE matched_term END true_term, i.ic, j.ic ic_true,
  (SELECT list_sort(list_distinct(flatten(list(codes)))) FROM t_codes c WHERE c.gene = p.gene AND (
     (kind = 'exact' AND c.term = p.term) OR
     (kind = 'upward' AND EXISTS (SELECT 1 FROM t_closed x WHERE x.src = c.term AND x.anc = p.term AND x.depth > 0)) OR
     (kind = 'downward' AND EXISTS (SELECT 1 FROM t_closed x WHERE x.src = p.term AND x.anc = c.term AND x.depth > 0)))) codes
FROM t_match p LEFT JOIN t_ic i ON i.term = p.term
LEFT JOIN t_ic j ON j.term = CASE WHEN kind = 'exact' THEN p.term ELSE matched_term END""")


def properties(m):
    codes = (m.annotations.filter("evidence <> 'R'").groupBy("gene", "term")
             .agg(F.array_sort(F.collect_set("evidence")).alias("codes")))
    return profile.term_properties(matched(m), codes, m.closed, m.ic, ("A",))


@query("term_properties", """
SELECT gene, CAST(term AS BIGINT) term, kind, CAST(true_term AS BIGINT) true_term, round(ic, 6) ic, round(ic_true, 6) ic_true,
  round(ic_true - ic, 6) ic_gap, array_to_string(codes, ',') codes, list_contains(codes, 'A') experimental FROM t_props""")
def _(m):
    return rounded(properties(m).select("gene", "term", "kind", "true_term", "ic", "ic_true", "ic_gap",
                                        F.array_join("codes", ",").alias("codes"), "experimental"))


@query("evidence_strength", """
SELECT list_contains(codes, 'A') experimental, count(*) n FROM t_props WHERE kind <> 'no_match' GROUP BY 1""")
def _(m):
    return profile.evidence_strength(properties(m))


@query("gene_properties", """
SELECT g.gene, n_positive, (SELECT count(DISTINCT item) FROM t_obs) n_total,
  round(n_positive / CAST((SELECT count(DISTINCT item) FROM t_obs) AS DOUBLE), 6) breadth, n_exact, n_upward, n_downward, n_no_match,
  round(flagged, 6) frac_flagged, round(f1_top1, 6) f1_top1, family
FROM (SELECT gene, count(*) FILTER (value = 1) n_positive FROM t_obs GROUP BY 1) g LEFT JOIN t_match_genes USING (gene)
LEFT JOIN (SELECT gene, coalesce(count(*) FILTER (n >= 15 AND (r > 0.95 OR r < 0.05)) / nullif(CAST(count(*) FILTER (n >= 15) AS DOUBLE), 0), 0) flagged
  FROM (SELECT gene, tissue, count(*) n, avg(value) r FROM t_obs WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (gene)
LEFT JOIN t_ceilings USING (gene) LEFT JOIN s_family USING (gene)""")
def _(m):
    return rounded(profile.gene_properties(matrix.expression_summary(m.obs), match_genes(m), enrichment.tissue_homogeneity(m.obs),
                                           model_ceilings(m), families(m)))


fragment("t_second_match", classify_sql("""
SELECT gene, term FROM (SELECT gene, term, row_number() OVER (PARTITION BY gene ORDER BY pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), term) r FROM t_ora
WHERE unit = 'rows')""", "gene"))


def _arm_sql(arm: str, source: str) -> str:
    flags = [(f"{arm}_{w}_at_{k}", f"{c} AND rank <= {k}") for w, c in (("match", "kind <> 'no_match'"), ("exact", "kind = 'exact'")) for k in (1, 3, 10)]
    flags += [(f"{arm}_any_match", "kind <> 'no_match'"), (f"{arm}_any_exact", "kind = 'exact'")]
    kinds = ", ".join(f"count(*) FILTER (kind = '{k}') {arm}_n_{k}" for k in ("exact", "upward", "downward", "no_match"))
    return (f" LEFT JOIN (SELECT gene, count(*) {arm}_n, {kinds}, "
            + ", ".join(f"CAST(max(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) {n}" for n, c in flags) + f" FROM {source} GROUP BY 1) {arm} ON {arm}.gene = s_suppkey")


GENE_COLUMNS = [f"{arm}_{c}" for arm in ("first", "second") for c in
                ("n", "n_exact", "n_upward", "n_downward", "n_no_match", *(f"{w}_at_{k}" for w in ("match", "exact") for k in (1, 3, 10)), "any_match", "any_exact")]


@query("gene_table", "SELECT s_suppkey gene, " + ", ".join(f"coalesce({n}, 0) {n}" for n in [*GENE_COLUMNS, "n_duplicate"]) + " FROM supplier "
       + _arm_sql("first", "(SELECT m.gene, kind, rank FROM t_match m JOIN t_rank_ora r ON r.gene = m.gene AND r.term = m.term AND r.unit = 'cell_types')")
       + _arm_sql("second", "(SELECT m.gene, kind, rank FROM t_second_match m JOIN (SELECT gene, term, row_number() OVER (PARTITION BY gene ORDER BY pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), term) AS rank FROM t_ora WHERE unit = 'rows') r ON r.gene = m.gene AND r.term = m.term)")
       + " LEFT JOIN (SELECT gene, CAST(sum(n_duplicate) AS BIGINT) n_duplicate FROM e_runs GROUP BY 1) d ON d.gene = s_suppkey")
def _(m):
    from enrichspark.operators.ranking import significant_rank
    from enrichspark.plans.q_compare import event_runs
    first = matching.classify(predictions(m), m.truths, m.closed)
    rows = m.enriched.filter("unit = 'rows'").select("gene", "term", stable_p().alias("p"))
    second = matching.classify(significant_rank(rows, "p", 1.1).drop("p"), m.truths, m.closed)
    answers = event_runs(m).groupBy("gene").agg(F.sum(F.col("n_valid") + F.col("n_invalid") + F.col("n_duplicate")).alias("n_raw"),
                                                F.sum("n_valid").alias("n_valid"), F.sum("n_invalid").alias("n_invalid"))
    return rounded(profile.gene_table(m.table("supplier").select(F.col("s_suppkey").alias("gene")), first, second, answers))


@query("funnel", """
SELECT count(*) genes, count(*) FILTER (n_exact + n_upward + n_downward + n_no_match > 0) any_term,
  count(*) FILTER (n_exact + n_upward + n_downward > 0) any_match, count(*) FILTER (n_exact > 0) any_exact FROM t_match_genes""")
def _(m):
    return profile.funnel(match_genes(m))


# -- rates by bins, over the customer population
HIT = "CASE WHEN done THEN 1 ELSE 0 END"


def _rate_sql(bin_sql: str, where: str = "TRUE") -> str:
    return f"SELECT {bin_sql} AS bin, count(*) n, CAST(sum({HIT}) AS BIGINT) hits, round(avg({HIT}), 6) rate FROM c_universe WHERE {where} GROUP BY 1"


@query("rate_by_breadth_decile", _rate_sql("CAST(least(9, greatest(0, ceil(round((breadth + 1000) / 12000 * 10, 9)) - 1)) AS BIGINT)"))
def _(m):
    return rounded(profile.rate_by(universe(m), profile.decile_bin((F.col("breadth") + 1000) / 12000), "done"))


@query("rate_by_richness", _rate_sql("""CASE WHEN n_direct_terms <= 2 THEN '1-2' WHEN n_direct_terms <= 5 THEN '3-5' WHEN n_direct_terms <= 10
  THEN '6-10' WHEN n_direct_terms <= 20 THEN '11-20' ELSE '21+' END""", "n_direct_terms > 0"))
def _(m):
    return rounded(profile.rate_by(universe(m).filter("n_direct_terms > 0"), profile.richness_bin(F.col("n_direct_terms")), "done"))


@query("rate_by_confidence", _rate_sql("""CAST(CASE WHEN score <= 0.1 THEN 0 WHEN score <= 0.2 THEN 1 WHEN score <= 0.3 THEN 2 WHEN score <= 0.4 THEN 3
  WHEN score <= 0.45 THEN 4 ELSE 5 END AS BIGINT)"""))
def _(m):
    return rounded(profile.rate_by(universe(m), profile.confidence_bin(F.col("score"), (0.1, 0.2, 0.3, 0.4, 0.45)), "done"))


@query("rate_by_rank", """
SELECT CASE rank WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS bin, count(*) n, CAST(sum(CASE WHEN kind <> 'no_match' THEN 1 ELSE 0 END) AS BIGINT) hits,
  round(avg(CASE WHEN kind <> 'no_match' THEN 1 ELSE 0 END), 6) rate
FROM t_match m JOIN t_rank_ora r ON r.gene = m.gene AND r.term = m.term AND r.unit = 'cell_types' GROUP BY 1""")
def _(m):
    rows = matching.classify(predictions(m), m.truths, m.closed).withColumn("hit", F.col("kind") != "no_match")
    return rounded(profile.rate_by(rows, profile.rank_bucket(F.col("rank")), "hit"))


@query("rate_by_ic_quintile", """
WITH e AS (SELECT quantile_cont(mean_true_ic, 0.2) a, quantile_cont(mean_true_ic, 0.4) b, quantile_cont(mean_true_ic, 0.6) c,
  quantile_cont(mean_true_ic, 0.8) d FROM t_chance)
SELECT CAST(CASE WHEN mean_true_ic <= a THEN 0 WHEN mean_true_ic <= b THEN 1 WHEN mean_true_ic <= c THEN 2 WHEN mean_true_ic <= d THEN 3 ELSE 4 END AS BIGINT) AS bin,
  count(*) n, CAST(sum(CASE WHEN n_exact + n_upward + n_downward > 0 THEN 1 ELSE 0 END) AS BIGINT) hits,
  round(avg(CASE WHEN n_exact + n_upward + n_downward > 0 THEN 1 ELSE 0 END), 6) rate
FROM t_chance JOIN t_match_genes USING (gene), e GROUP BY 1""")
def _(m):
    from enrichspark.session import materialize
    rows = materialize(chance(m).join(match_genes(m), "gene").withColumn(
        "hit", F.col("n_exact") + F.col("n_upward") + F.col("n_downward") > 0).withColumn("mean_true_ic", F.col("mean_true_ic")), "quintile")
    edges = coverage.quantile_edges(rows, "mean_true_ic", 5)
    return rounded(profile.rate_by(rows, coverage.bin_right_closed(F.col("mean_true_ic"), edges), "hit"))


@query("opportunity_rate", """
SELECT gene, round(CASE WHEN n > 0 THEN hits / CAST(n AS DOUBLE) END, 6) rate FROM (
  SELECT gene, n_exact + n_upward + n_downward hits, n_exact + n_upward + n_downward + n_no_match n FROM t_match_genes)""")
def _(m):
    hits = F.col("n_exact") + F.col("n_upward") + F.col("n_downward")
    n = hits + F.col("n_no_match")
    return rounded(match_genes(m).select("gene", F.when(n > 0, hits / n).alias("rate")))


@query("concentration", """
SELECT l_partkey, n, round(n / CAST(t AS DOUBLE), 8) AS share, round(c / CAST(t AS DOUBLE), 6) cumulative_share FROM (
  SELECT l_partkey, count(*) n, sum(count(*)) OVER () t, sum(count(*)) OVER (ORDER BY -count(*), l_partkey) c FROM lineitem GROUP BY 1)""")
def _(m):
    return rounded(profile.concentration(m.table("lineitem"), "l_partkey").withColumn("cumulative_share", F.round("cumulative_share", 6)), 8)


@query("top_labels", """
SELECT CAST(term AS BIGINT) term, count(*) n, round(avg(CASE WHEN kind = 'exact' THEN 1.0 ELSE 0.0 END), 6) share_exact,
  round(avg(CASE WHEN kind = 'upward' THEN 1.0 ELSE 0.0 END), 6) share_upward, round(avg(CASE WHEN kind = 'downward' THEN 1.0 ELSE 0.0 END), 6) share_downward,
  round(avg(CASE WHEN kind = 'no_match' THEN 1.0 ELSE 0.0 END), 6) share_no_match FROM t_match GROUP BY 1 ORDER BY n DESC, term LIMIT 20""")
def _(m):
    return rounded(profile.top_labels(matched(m)))


@query("pair_table", """
SELECT CAST(term AS BIGINT) term, CAST(true_term AS BIGINT) true_term, count(*) n, round(quantile_cont(abs(ic_true - ic), 0.5), 6) median_gap,
  quantile_cont(CAST(distance AS DOUBLE), 0.5) median_edges FROM t_props WHERE kind IN ('upward', 'downward') GROUP BY 1, 2""")
def _(m):
    from enrichspark.session import materialize
    return rounded(profile.pair_table(materialize(properties(m), "properties")))


@query("matches_by_true_term", """
SELECT CAST(true_term AS BIGINT) true_term, count(*) n_matches, count(DISTINCT gene) n_genes FROM t_props WHERE true_term IS NOT NULL GROUP BY 1""")
def _(m):
    return rounded(profile.by_true_term(properties(m)))


@query("empirical_distribution", """
SELECT f1_top1 AS value, round(sum(n) OVER (ORDER BY f1_top1) / CAST(sum(n) OVER () AS DOUBLE), 6) cdf_all,
  round(sum(h) OVER (ORDER BY f1_top1) / CAST(greatest(sum(h) OVER (), 1) AS DOUBLE), 6) cdf_hit FROM (
  SELECT f1_top1, count(*) n, count(*) FILTER (done) h FROM c_universe WHERE f1_top1 IS NOT NULL GROUP BY 1)""")
def _(m):
    return rounded(profile.empirical_distribution(universe(m), "f1_top1", "done"))


@query("contingency", """
SELECT CASE WHEN done AND rich THEN 'both' WHEN done THEN 'only_done' WHEN rich THEN 'only_rich' ELSE 'neither' END AS cell, count(*) n
FROM (SELECT done, n_direct_terms > 10 rich FROM c_universe) GROUP BY 1""")
def _(m):
    return profile.contingency(universe(m).withColumn("rich", F.col("n_direct_terms") > 10), "done", "rich")


@query("observed_vs_expected", """
SELECT kind, round(o, 6) observed, round(e, 6) expected, round(o / nullif(e, 0), 6) ratio FROM (
  SELECT unnest(['exact', 'upward', 'downward']) kind, unnest([sum(n_exact), sum(n_upward), sum(n_downward)])::DOUBLE o,
    unnest([sum(n * chance_exact), sum(n * chance_upward), sum(n * chance_downward)]) e
  FROM (SELECT *, n_exact + n_upward + n_downward + n_no_match n FROM t_match_genes) JOIN t_chance USING (gene))""")
def _(m):
    return rounded(profile.observed_vs_expected(match_genes(m), chance(m)))


fragment("t_transfer_match", classify_sql("SELECT gene, term FROM t_transfer WHERE unit = 'cell_types' AND rank <= 10", "gene"))


@query("copied_vs_added", """
SELECT w.c IS NOT NULL in_table, count(*) n, round(avg(CASE WHEN kind <> 'no_match' THEN 1.0 ELSE 0.0 END), 6) match_rate
FROM t_transfer_match m LEFT JOIN (SELECT DISTINCT gene, c FROM t_weights WHERE unit = 'cell_types') w ON w.gene = m.gene AND w.c = m.term GROUP BY 1""")
def _(m):
    w = transfer.evidence_weights(m.corrected).filter("unit = 'cell_types'")
    top = transfer.transfer_rank(w, assoc(m), m.propagated, ["unit", "gene"]).filter("rank <= 10").select("gene", "term")
    return rounded(profile.copied_vs_added(matching.classify(top, m.truths, m.closed), w.select("gene", F.col("c").alias("term"))))


# -- annotations
fragment("a_rows", """
SELECT l_orderkey * 10 + l_linenumber row_id, 'S' || l_suppkey accession, CASE WHEN l_tax = 0.0 THEN 'NOT|involved' ELSE '' END qualifier,
  l_partkey AS term, CASE l_returnflag WHEN 'R' THEN 'IEA' WHEN 'A' THEN 'IDA' ELSE 'TAS' END evidence,
  CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'C' END aspect FROM lineitem""")
fragment("a_idmap", "SELECT s_suppkey // 2 gene, 'S' || s_suppkey accession FROM supplier WHERE s_acctbal > 0 UNION SELECT 1000000 + s_suppkey, 'S' || s_suppkey FROM supplier WHERE s_acctbal > 5000")
fragment("a_terms", "SELECT p_partkey any_id, CASE WHEN p_size < 5 THEN p_partkey // 2 ELSE p_partkey END primary_id, p_type <> 'PROMO' is_process FROM part")
fragment("a_marked", """
SELECT r.*, primary_id, CASE WHEN aspect <> 'P' THEN 'other_aspect' WHEN qualifier LIKE '%NOT%' THEN 'not_qualified'
  WHEN evidence IN ('IEA', 'ND') THEN 'excluded_evidence_' || evidence
  WHEN accession NOT IN (SELECT accession FROM a_idmap) THEN 'accession_unmapped'
  WHEN NOT coalesce(is_process, FALSE) THEN 'term_unresolved' END drop_reason
FROM a_rows r LEFT JOIN a_terms ON any_id = term""")


def marked(m, excluded=annotations.EXCLUDED_EVIDENCE):
    rows = m.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.concat(F.lit("S"), "l_suppkey").alias("accession"),
        F.when(F.col("l_tax") == 0.0, "NOT|involved").otherwise("").alias("qualifier"), F.col("l_partkey").alias("term"),
        F.when(F.col("l_returnflag") == "R", "IEA").when(F.col("l_returnflag") == "A", "IDA").otherwise("TAS").alias("evidence"),
        F.when(F.col("l_linestatus") == "F", "P").otherwise("C").alias("aspect"))
    part = m.table("part")
    terms = part.select(F.col("p_partkey").alias("any_id"), F.when(F.col("p_size") < 5, F.floor(F.col("p_partkey") / 2))
                        .otherwise(F.col("p_partkey")).alias("primary_id"), (F.col("p_type") != "PROMO").alias("is_process"))
    return annotations.mark_annotations(rows, idmap(m), terms, "P", excluded)


def idmap(m):
    s = m.table("supplier")
    acc = F.concat(F.lit("S"), "s_suppkey").alias("accession")
    return (s.filter("s_acctbal > 0").select(F.floor(F.col("s_suppkey") / 2).alias("gene"), acc)
            .unionByName(s.filter("s_acctbal > 5000").select((F.col("s_suppkey") + 1000000).alias("gene"), acc)))


@query("annotation_filter_stats", "SELECT coalesce(drop_reason, 'kept') outcome, count(*) n FROM a_marked GROUP BY 1")
def _(m):
    return annotations.filter_stats(marked(m))


@query("filter_annotations", "SELECT DISTINCT gene, primary_id term FROM a_marked JOIN a_idmap USING (accession) WHERE drop_reason IS NULL")
def _(m):
    return annotations.gene_annotations(marked(m), idmap(m))


@query("include_electronic_evidence", """
SELECT DISTINCT gene, primary_id term FROM a_rows r JOIN a_terms ON any_id = term JOIN a_idmap USING (accession)
WHERE aspect = 'P' AND qualifier NOT LIKE '%NOT%' AND evidence <> 'ND' AND is_process""")
def _(m):
    return annotations.gene_annotations(marked(m, ("ND",)), idmap(m))


@query("annotation_evidence", """
SELECT gene, primary_id term, string_agg(DISTINCT evidence, ',' ORDER BY evidence) codes FROM a_marked JOIN a_idmap USING (accession)
WHERE drop_reason IS NULL GROUP BY 1, 2""")
def _(m):
    return annotations.annotation_evidence(marked(m), idmap(m)).withColumn("codes", F.array_join("codes", ","))


@query("first_terms", """
SELECT gene, CAST(term AS BIGINT) term, rank FROM (SELECT gene, term, row_number() OVER (PARTITION BY gene ORDER BY term) AS rank
  FROM (SELECT DISTINCT gene, term FROM t_ann WHERE evidence <> 'R')) WHERE rank <= 10""")
def _(m):
    return rounded(annotations.first_terms(m.annotations, ("R",), 10))


@query("significance_filter", """
SELECT 'v2' AS version, unit, gene, CAST(term AS BIGINT) term, 'p_gscs < 0.05' basis FROM t_gscs WHERE significant
UNION ALL SELECT 'v4', unit, gene, CAST(term AS BIGINT), 'q < 0.05' FROM t_corrected WHERE tested AND round(q, 9) < 0.05
UNION ALL SELECT 'v5', unit, gene, CAST(term AS BIGINT), 'none' FROM t_rank_ora""")
def _(m):
    sources = {"v2": m.tested, "v4": m.corrected, "v5": rank_ora(m)}
    parts = [ranking.significant_terms(df, v).select(F.lit(v).alias("version"), "unit", "gene", "term", "basis") for v, df in sources.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))
