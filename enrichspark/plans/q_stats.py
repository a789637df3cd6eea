"""Enrichment, evidence and correction queries."""

from pyspark.sql import functions as F

from enrichspark.functions.corrections import adjust_large
from enrichspark.functions.exact import hypergeometric_tail
from enrichspark.operators import enrichment, evidence, matrix, ranking
from enrichspark.plans.registry import query, rounded, stable_p
from enrichspark.plans.sql import bh, binomial, fisher, fragment, h32, hyper_tail

fragment("t_counts", """
SELECT gene, kind, term, count(*) FILTER (value = 1) n_pos, count(*) FILTER (value = 0) n_neg
FROM t_obs JOIN t_features USING (item) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
fragment("t_totals", """
SELECT gene, count(*) FILTER (value = 1) all_pos, count(*) FILTER (value = 0) all_neg FROM t_obs GROUP BY 1""")


@query("feature_counts", "SELECT gene, kind, term, n_pos, n_neg FROM t_counts")
def _(m):
    return enrichment.feature_counts(m.obs, m.features)


@query("min_feature_count", "SELECT gene, kind, term, n_pos + n_neg AS n FROM t_counts WHERE n_pos + n_neg >= 20")
def _(m):
    n = F.col("n_pos") + F.col("n_neg")
    return enrichment.feature_counts(m.obs, m.features).filter(n >= 20).select("gene", "kind", "term", n.alias("n"))


@query("fisher_enrichment", f"""
WITH c AS (
  SELECT gene, kind, term, count(*) FILTER (value = 1) a, count(*) FILTER (value = 0) b
  FROM t_obs JOIN t_features_v1 USING (item) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
p AS (
  SELECT gene, kind, term, a, b, all_pos, all_neg,
    all_pos = 0 OR all_neg = 0 OR a + b = 0 OR a + b = all_pos + all_neg AS flat,
    {fisher('a', 'b', 'all_pos', 'all_neg')} AS p0
  FROM c JOIN t_totals USING (gene) WHERE a + b >= 20),
ranked AS (SELECT *, CASE WHEN flat THEN 1.0 ELSE p0 END p FROM p),
r2 AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p) _r, count(*) OVER (PARTITION BY gene) _m FROM ranked)
SELECT gene, kind, term, a n_pos, b n_neg,
  round(CASE WHEN flat THEN NULL WHEN b > 0 AND all_pos - a > 0 THEN a * (all_neg - b) / CAST(b * (all_pos - a) AS DOUBLE)
        ELSE 'inf'::DOUBLE END, 6) odds_ratio,
  round(p, 6) p, round({bh('p', 'gene')}, 6) q FROM r2""")
def _(m):
    return rounded(enrichment.fisher_enrichment(m.obs, m.features_v1))


fragment("t_feature_baselines", """
SELECT kind, term, round(avg(rate), 6) baseline, count(*) n_genes FROM (
  SELECT gene, kind, term, avg(CAST(value AS DOUBLE)) rate FROM t_obs JOIN t_features USING (item)
  WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 50""")
fragment("t_row_grand", """
SELECT round(avg(rate), 6) grand FROM (
  SELECT gene, avg(CAST(value AS DOUBLE)) rate FROM t_obs WHERE value IS NOT NULL GROUP BY 1)""")
fragment("t_two_factor", f"""
SELECT * FROM (
SELECT gene, kind, term, n_pos, n_neg, baseline, expected, tested, n_pos / CAST(n_pos + n_neg AS DOUBLE) observed,
  CASE WHEN tested THEN {binomial('n_pos', '(n_pos + n_neg)', 'expected')} END p
FROM (SELECT gene, kind, term, n_pos, n_neg, baseline, baseline IS NOT NULL tested,
        CASE WHEN baseline IS NOT NULL THEN least(0.999, greatest(0.001,
          all_pos / CAST(all_pos + all_neg AS DOUBLE) * baseline / grand)) END expected
      FROM t_counts JOIN t_totals USING (gene) LEFT JOIN (SELECT kind, term, baseline FROM t_feature_baselines)
        USING (kind, term), t_row_grand WHERE n_pos + n_neg >= 20))""")


@query("feature_baselines", "SELECT kind, term, baseline, n_genes FROM t_feature_baselines")
def _(m):
    return evidence.feature_baselines(m.obs, m.features, m.min_genes())


def _two_factor(m):
    base = evidence.feature_baselines(m.obs, m.features, m.min_genes())
    rates = matrix.gene_rates(m.obs.withColumn("unit", F.lit("rows")))
    grand = rates.agg(F.round(F.avg("rate"), 6)).scalar()
    return enrichment.two_factor_enrichment(m.obs, m.features, base, grand)


@query("two_factor_enrichment", f"""
WITH r2 AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p NULLS LAST) _r,
              count(p) OVER (PARTITION BY gene) _m FROM t_two_factor)
SELECT gene, kind, term, n_pos, n_neg, tested, baseline, round(expected, 6) expected,
  round(observed - expected, 6) excess,
  round(CASE WHEN NOT tested THEN NULL WHEN observed >= 1 THEN 'inf'::DOUBLE WHEN observed <= 0 THEN 0.0
        ELSE (observed / (1 - observed)) / (expected / (1 - expected)) END, 6) odds_ratio,
  round(p, 6) p, round(CASE WHEN tested THEN {bh('p', 'gene')} END, 6) q FROM r2""")
def _(m):
    rows = _two_factor(m)
    return rounded(rows.withColumn("q", F.when(F.col("tested"), F.col("q"))))


@query("skipped_without_baseline", "SELECT gene, count(*) FILTER (NOT tested) n_skipped FROM t_two_factor GROUP BY 1")
def _(m):
    return _two_factor(m).groupBy("gene").agg(F.count_if(~F.col("tested")).alias("n_skipped"))


@query("effect_floor", """
SELECT gene, kind, term, round(observed - expected, 6) excess FROM t_two_factor
WHERE tested AND abs(observed - expected) >= 0.10""")
def _(m):
    return rounded(enrichment.effect_floor(_two_factor(m).filter("tested")).select("gene", "kind", "term", "excess"))


@query("top_effects", """
WITH s AS (SELECT gene, kind, term, CASE WHEN observed - expected > 0 THEN 'enriched' ELSE 'depleted' END side,
             round(abs(observed - expected), 12) e FROM t_two_factor WHERE tested),
r AS (SELECT *, row_number() OVER (PARTITION BY gene, side ORDER BY e DESC, kind, term) AS rank FROM s)
SELECT gene, side, rank, kind, term FROM r WHERE rank <= CASE WHEN side = 'enriched' THEN 8 ELSE 5 END""")
def _(m):
    return rounded(ranking.top_effects(_two_factor(m)).select("gene", "side", "rank", "kind", "term"))


@query("tissue_homogeneity", """
WITH per AS (SELECT gene, tissue, count(*) n, avg(value) rate FROM t_obs WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT gene, count(*) FILTER (n >= 15) n_considered, count(*) FILTER (n >= 15 AND (rate > 0.95 OR rate < 0.05)) n_flagged,
  round(coalesce(count(*) FILTER (n >= 15 AND (rate > 0.95 OR rate < 0.05)) / nullif(CAST(count(*) FILTER (n >= 15) AS DOUBLE), 0), 0), 6) frac_flagged
FROM per GROUP BY 1""")
def _(m):
    return rounded(enrichment.tissue_homogeneity(m.obs))


fragment("t_ora", f"""
SELECT *, row_number() OVER (PARTITION BY unit, gene ORDER BY p) _r, count(*) OVER (PARTITION BY unit, gene) _m FROM (
SELECT unit, gene, term, term_size, hits, n_background, query_size,
  query_size * term_size / CAST(n_background AS DOUBLE) expected,
  hits / (query_size * term_size / CAST(n_background AS DOUBLE)) fold,
  {hyper_tail('hits', 'n_background', 'term_size', 'query_size')} p
FROM (SELECT unit, gene, term, count(*) term_size, count(*) FILTER (value = 1) hits
      FROM t_called JOIN t_carriers USING (ct) GROUP BY 1, 2, 3 HAVING count(*) >= 3)
JOIN (SELECT unit, gene, count(*) n_background, count(*) FILTER (value = 1) query_size FROM t_called GROUP BY 1, 2)
USING (unit, gene) WHERE query_size > 0)""")


@query("over_representation", f"""
SELECT unit, gene, CAST(term AS BIGINT) term, term_size, hits intersection, n_background, query_size,
  round(expected, 6) expected, round(fold, 6) fold, round(hits / CAST(query_size AS DOUBLE), 6) AS precision,
  round(hits / CAST(term_size AS DOUBLE), 6) recall, round(p, 6) p, round(least(1.0, p * _m), 6) p_bonferroni,
  round({bh('p', 'unit, gene')}, 6) p_bh FROM t_ora""")
def _(m):
    return rounded(m.enrich())


@query("enrichment_diagnostics", """
SELECT unit, gene, max(n_background) n_background, max(query_size) query_size, count(*) n_terms_tested,
  round(max(fold), 6) max_fold, round(max(query_size) / CAST(max(n_background) AS DOUBLE), 6) query_background_ratio,
  round(max(n_background) / CAST(max(query_size) AS DOUBLE), 6) max_fold_possible,
  max(query_size) / CAST(max(n_background) AS DOUBLE) > 0.5 AS low_power
FROM t_ora GROUP BY 1, 2""")
def _(m):
    return rounded(enrichment.diagnostics(m.enriched))


@query("term_size_filter", """
SELECT unit, gene, CAST(term AS BIGINT) term, term_size FROM t_ora WHERE term_size <= 6""")
def _(m):
    rows = enrichment.over_representation(m.units, m.carriers, 3, 6)
    return rounded(rows.select("unit", "gene", "term", "term_size"))


@query("hypergeometric_tail", f"""
SELECT gene, CAST(ct AS BIGINT) ct, k, K2, round({hyper_tail('k', 'nn', 'K2', 'n0')}, 6) p FROM (
 SELECT gene, ct, count(*) FILTER (value = 1) k, count(*) K2 FROM t_obs WHERE value IS NOT NULL GROUP BY 1, 2)
 JOIN (SELECT gene, count(value) AS nn, count(*) FILTER (value = 1) n0 FROM t_obs GROUP BY 1) USING (gene)""")
def _(m):
    called = m.obs.filter("value IS NOT NULL")
    per = called.groupBy("gene", "ct").agg(F.count_if(F.col("value") == 1).alias("k"), F.count("*").alias("K2"))
    tot = called.groupBy("gene").agg(F.count("*").alias("nn"), F.count_if(F.col("value") == 1).alias("n0"))
    p = hypergeometric_tail("k", "nn", "K2", "n0")
    return rounded(per.join(tot, "gene").select("gene", "ct", "k", "K2", p.alias("p")))


fragment("t_part_p", """
SELECT l_suppkey family, l_partkey id, (1 + CAST(round(sum(l_extendedprice)) AS BIGINT) % 100000) / 100001.0 p
FROM lineitem GROUP BY 1, 2""")


def _part_p(m):
    return (m.table("lineitem").groupBy(F.col("l_suppkey").alias("family"), F.col("l_partkey").alias("id"))
            .agg(((1 + F.round(F.sum("l_extendedprice")).cast("long") % 100000) / 100001.0).alias("p")))


def _adjusted(m):
    return adjust_large(_part_p(m), "p", ["family"], ["id"], "bonferroni", "benjamini_hochberg", "holm")


fragment("t_part_ranked", """
SELECT family, id, CAST(p AS DOUBLE) p, row_number() OVER (PARTITION BY family ORDER BY p) _r, count(*) OVER (PARTITION BY family) _m
FROM t_part_p""")


@query("bonferroni", "SELECT family, id, round(least(1.0, p * _m), 6) adj FROM t_part_ranked")
def _(m):
    return rounded(_adjusted(m).select("family", "id", F.col("bonferroni").alias("adj")))


@query("benjamini_hochberg", f"SELECT family, id, round({bh('p', 'family')}, 6) adj FROM t_part_ranked")
def _(m):
    return rounded(_adjusted(m).select("family", "id", F.col("benjamini_hochberg").alias("adj")))


@query("holm", """
SELECT family, id, round(least(1.0, max((_m - _r + 1) * p) OVER (PARTITION BY family ORDER BY _r)), 6) adj
FROM t_part_ranked""")
def _(m):
    return rounded(_adjusted(m).select("family", "id", F.col("holm").alias("adj")))


# -- evidence
@query("called_universe", "SELECT unit, gene, item FROM t_called")
def _(m):
    return evidence.called_universe(m.units, m.carriers).select("unit", "gene", "item")


@query("annotated_universe", "SELECT DISTINCT unit, item FROM t_units WHERE ct IN (SELECT ct FROM t_carriers)")
def _(m):
    return evidence.annotated_universe(m.units, m.carriers)


@query("evidence_counts", "SELECT unit, gene, CAST(term AS BIGINT) term, size, hits FROM t_evidence")
def _(m):
    return rounded(m.evidence)


@query("candidate_vocabulary", """
SELECT CAST(s.process AS BIGINT) term, count(DISTINCT l_partkey) n_cell_types FROM lineitem
JOIN (SELECT p_partkey, p_size process FROM part) s ON l_partkey = p_partkey GROUP BY 1
HAVING count(DISTINCT l_partkey) >= 3""")
def _(m):
    from enrichspark.operators.vocabulary import candidate_vocabulary
    sizes = m.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("term"))
    held = m.table("lineitem").join(sizes, "l_partkey").select(F.col("l_partkey").alias("ct"), "term")
    return rounded(candidate_vocabulary(held))


@query("cell_type_vocabulary", """
SELECT CAST(c.term AS BIGINT) term, count(DISTINCT c.ct) n_cell_types, count(DISTINCT o.item) n_rows,
       CASE WHEN any_value(status) = 'OK' THEN 'resolved' ELSE 'unresolved' END state
FROM t_carriers c JOIN t_items o USING (ct) LEFT JOIN t_terms ON id = c.term GROUP BY 1""")
def _(m):
    rows = m.carriers.join(m.items, "ct").join(m.terms.withColumnRenamed("id", "term"), "term", "left")
    return rounded(rows.groupBy("term").agg(
        F.count_distinct("ct").alias("n_cell_types"), F.count_distinct("item").alias("n_rows"),
        F.when(F.any_value("status") == "OK", "resolved").otherwise("unresolved").alias("state")))


@query("term_baselines", "SELECT unit, CAST(term AS BIGINT) term, baseline, n_genes FROM t_baselines")
def _(m):
    return rounded(m.baselines)


fragment("t_corrected", f"""
SELECT *, CASE WHEN tested THEN least(1.0, min(p * _m / _r) OVER (PARTITION BY unit, gene, tested ORDER BY _r DESC
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) ELSE 1.0 END q FROM (
SELECT *, row_number() OVER (PARTITION BY unit, gene, tested ORDER BY p) _r,
   count(*) OVER (PARTITION BY unit, gene, tested) _m FROM (
SELECT unit, gene, term, size, hits, tested, observed, expected, observed - expected excess,
   CASE WHEN tested THEN {binomial('hits', 'size', 'expected')} ELSE 1.0 END p FROM (
SELECT r.unit, r.gene, v.term, coalesce(e.size, 0) size, coalesce(e.hits, 0) hits,
   coalesce(e.size, 0) >= 3 AND baseline IS NOT NULL tested,
   coalesce(e.hits / CAST(e.size AS DOUBLE), 0.0) observed,
   CASE WHEN coalesce(e.size, 0) >= 3 AND baseline IS NOT NULL
        THEN least(0.999, greatest(0.001, rate * baseline / grand_mean)) END expected
FROM t_rates r CROSS JOIN t_vocab v LEFT JOIN t_evidence e USING (unit, gene, term)
LEFT JOIN t_baselines b ON b.unit = r.unit AND b.term = v.term JOIN t_grand g ON g.unit = r.unit)))""")


@query("corrected_stats", """
SELECT unit, gene, CAST(term AS BIGINT) term, size, hits, round(observed, 6) observed, round(expected, 6) expected,
  round(excess, 6) excess, tested, round(p, 6) p, round(q, 6) q FROM t_corrected""")
def _(m):
    return rounded(m.correct())


@query("row_process_coverage", """
SELECT gene, round(avg(CASE WHEN item IN (SELECT item FROM t_features WHERE kind = 'process') THEN 1.0 ELSE 0.0 END), 6) AS share
FROM t_obs WHERE value IS NOT NULL GROUP BY 1""")
def _(m):
    held = m.features.filter("kind = 'process'").select("item").distinct().withColumn("_h", F.lit(1.0))
    rows = m.obs.filter("value IS NOT NULL").join(held, "item", "left")
    return rounded(rows.groupBy("gene").agg(F.avg(F.coalesce("_h", F.lit(0.0))).alias("share")))


# -- simulated null: orders of the items of each universe, ranked by hash, one by one
N_SIM = 2000
ALPHA = 0.05
fragment("t_uni", """
SELECT unit, gene, md5(string_agg(item, ',' ORDER BY item)) u, count(*) nn, count(*) FILTER (value = 1) n FROM t_called GROUP BY 1, 2""")
fragment("t_uni_items", "SELECT DISTINCT unit, u, item, ct FROM t_called JOIN t_uni USING (unit, gene)")
fragment("t_asked", "SELECT DISTINCT unit, u, nn, n FROM t_uni WHERE n > 0")
fragment("t_sims", f"SELECT unnest(range(1, {N_SIM} + 1)) sim")
fragment("t_sim_hash", f"""
SELECT unit, item, sim, {h32('0', 'sim', 'item')} h FROM (SELECT DISTINCT unit, item FROM t_uni_items), t_sims""")
fragment("t_sim_place", """
SELECT unit, u, sim, ct, row_number() OVER (PARTITION BY unit, u, sim ORDER BY h, item) place
FROM t_uni_items JOIN t_sim_hash USING (unit, item)""")
fragment("t_uni_terms", """
SELECT unit, u, term, count(*) size FROM t_uni_items JOIN t_carriers USING (ct) GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
fragment("t_overlap", """
SELECT unit, u, nn, n, sim, size, k FROM (
  SELECT unit, u, nn, n, sim, term, count(*) k FROM t_sim_place JOIN t_asked USING (unit, u) JOIN t_carriers USING (ct) WHERE place <= n
  GROUP BY 1, 2, 3, 4, 5, 6) JOIN t_uni_terms USING (unit, u, term)""")
fragment("t_overlap_p", f"""
SELECT nn, n, size, k, {hyper_tail('k', 'nn', 'size', 'n')} p FROM (SELECT DISTINCT nn, n, size, k FROM t_overlap)""")
fragment("t_thresholds", """
SELECT unit, u, n, greatest(quantile_cont(coalesce(min_p, 1.0), 0.05), 2.2250738585072014e-308) threshold
FROM (SELECT * FROM t_asked SEMI JOIN t_uni_terms USING (unit, u)) CROSS JOIN t_sims
LEFT JOIN (SELECT unit, u, n, sim, min(p) min_p FROM t_overlap JOIN t_overlap_p USING (nn, n, size, k) GROUP BY 1, 2, 3, 4) USING (unit, u, n, sim)
GROUP BY 1, 2, 3""")
fragment("t_gscs", f"""
SELECT o.*, coalesce(threshold, {ALPHA}) threshold, least(1.0, p * ({ALPHA} / coalesce(threshold, {ALPHA}))) p_gscs,
  p * ({ALPHA} / coalesce(threshold, {ALPHA})) < {ALPHA} * (1 - 1e-9) significant
FROM t_ora o JOIN t_uni USING (unit, gene) LEFT JOIN t_thresholds USING (unit, u, n)""")


# -- rankings
@query("rank_corrected", """
SELECT unit, gene, CAST(term AS BIGINT) term, row_number() OVER (PARTITION BY unit, gene ORDER BY
    CASE WHEN NOT tested THEN 2 WHEN excess > 0 THEN 0 ELSE 1 END,
    CASE WHEN tested AND excess > 0 THEN pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)) END NULLS LAST, round(excess, 12) DESC NULLS LAST, pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), term) AS rank,
  round(CASE WHEN tested AND excess > 0 THEN -log10(greatest(pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), 1e-300)) ELSE 0.0 END, 6) score
FROM t_corrected""")
def _(m):
    return rounded(ranking.rank_corrected(m.corrected.withColumn("p", stable_p())))


@query("rank_corrected_by_effect", """
SELECT unit, gene, CAST(term AS BIGINT) term, row_number() OVER (PARTITION BY unit, gene ORDER BY
    CASE WHEN tested THEN 0 ELSE 2 END, round(excess, 12) DESC NULLS LAST, pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), term) AS rank
FROM t_corrected""")
def _(m):
    return rounded(ranking.rank_corrected(m.corrected.withColumn("p", stable_p()), "effect").drop("score"))


fragment("t_rank_ora", """
SELECT unit, gene, term, row_number() OVER (PARTITION BY unit, gene ORDER BY
    CASE WHEN p IS NULL THEN 2 WHEN fold > 1 THEN 0 ELSE 1 END,
    CASE WHEN fold > 1 THEN p END NULLS LAST, round(fold, 12) DESC NULLS LAST, p, term) AS rank,
  CASE WHEN fold > 1 THEN -log10(greatest(p, 1e-300)) ELSE 0.0 END score
FROM (SELECT r.unit, r.gene, v.term, round(o.p, 10) p, o.fold FROM t_rates r CROSS JOIN t_vocab v
      LEFT JOIN t_ora o USING (unit, gene, term))""")


def rank_ora(m, by="p"):
    return ranking.rank_over_representation(m.enriched.withColumn("p", stable_p()), m.rates, m.vocabulary, by)


@query("rank_over_representation", "SELECT unit, gene, CAST(term AS BIGINT) term, rank, round(score, 6) score FROM t_rank_ora")
def _(m):
    return rounded(rank_ora(m))


@query("significant_rank", """
SELECT unit, gene, CAST(term AS BIGINT) term, row_number() OVER (PARTITION BY unit, gene ORDER BY pow(10, round(log10(CASE WHEN p < 1e-300 THEN 1e-300 ELSE p END), 9)), term) AS rank
FROM t_gscs WHERE significant""")
def _(m):
    rows = m.tested.filter("significant").select("unit", "gene", "term", stable_p().alias("p"))
    return rounded(ranking.significant_rank(rows, "p", 1.0, ["unit", "gene"]).drop("p"))


# -- simulated null
@query("gscs_thresholds", """
SELECT unit, nn n_items, n, count(*) n_genes, round(avg(threshold), 8) threshold FROM t_uni JOIN t_thresholds USING (unit, u, n) GROUP BY 1, 2, 3""")
def _(m):
    rows = m.null_genes.join(m.thresholds, ["unit", "universe", "n"])
    return rounded(rows.groupBy("unit", "n_items", "n").agg(F.count("*").alias("n_genes"), F.avg("threshold").alias("threshold")), 8)


@query("gscs_enrichment", f"""
SELECT unit, gene, CAST(term AS BIGINT) term, round(p_gscs, 6) p_gscs, significant,
  round({hyper_tail('least(term_size, query_size)', 'n_background', 'term_size', 'query_size')}, 6) p_floor,
  {hyper_tail('least(term_size, query_size)', 'n_background', 'term_size', 'query_size')} <= threshold * (1 + 1e-6) AS reachable
FROM t_gscs""")
def _(m):
    return rounded(m.tested.select("unit", "gene", "term", "p_gscs", "p_floor", "significant",
                                   (F.col("p_floor") <= F.col("threshold") * (1 + 1e-6)).alias("reachable")))
