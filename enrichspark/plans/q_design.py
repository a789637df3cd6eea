"""Contrast design queries: line items as cells, part sizes as cell types, orders as donors."""

from pyspark.sql import functions as F

from enrichspark.functions.text import jaccard, normalise
from enrichspark.operators import design
from enrichspark.plans.registry import query, rounded
from enrichspark.plans.sql import fragment, h32

fragment("d_bulk", """
SELECT *, nullif(concat_ws('; ', CASE WHEN n_cells < 5 THEN 'n_cells < 5' END, CASE WHEN n_donors < 2 THEN 'n_donors < 2' END), '') excluded FROM (
  SELECT l_suppkey gene, CAST(p_size AS INT) ct, avg(v) mean_expr, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) pct_expressing, count(*) n_cells,
    count(DISTINCT l_orderkey) n_donors, 'R' || (p_size % 5) tissue
  FROM (SELECT *, greatest(l_quantity - 25, 0) v FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1, p_size)""")
fragment("d_sides", """
SELECT *, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN pct_expressing >= 0.6 THEN 'positive' WHEN pct_expressing <= 0.4 THEN 'negative'
  ELSE 'excluded' END side FROM d_bulk""")


def bulk(m):
    part = m.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("int").alias("ct"))
    cells = m.table("lineitem").join(part, "l_partkey").select(
        F.col("l_suppkey").alias("gene"), "ct", F.col("l_orderkey").alias("donor"), F.greatest(F.col("l_quantity") - 25, F.lit(0.0)).alias("value"))
    return design.pseudobulk(cells, 5, 2)


def sides(m):
    return design.three_way(bulk(m), 0.6, 0.4).withColumn("tissue", F.concat(F.lit("R"), F.col("ct") % 5))


@query("pseudobulk", """
SELECT gene, CAST(ct AS BIGINT) ct, round(mean_expr, 6) mean_expr, round(pct_expressing, 6) pct_expressing, n_cells, n_donors, excluded FROM d_bulk""")
def _(m):
    return rounded(bulk(m))


@query("distribution_summary", """
SELECT gene, n_above_zero, n_majority, round(max_mean, 6) max_mean, round(median_mean, 6) median_mean, n_supported, n_excluded, round(breadth, 6) breadth,
  CASE WHEN n_supported IS NULL THEN 'gene_absent' WHEN coalesce(max_mean, 0) <= 0 THEN 'all_zero' WHEN breadth >= 0.55 THEN 'ubiquitous' ELSE 'proceed' END verdict
FROM (SELECT g.gene, n_above_zero, n_majority, max_mean, median_mean, n_supported, n_excluded, n_majority / nullif(CAST(n_supported AS DOUBLE), 0) breadth
  FROM (SELECT s_suppkey gene FROM supplier UNION ALL SELECT 1000000 + s_suppkey FROM supplier) g LEFT JOIN (
  SELECT gene, count(*) FILTER (excluded IS NULL AND mean_expr > 0) n_above_zero, count(*) FILTER (excluded IS NULL AND pct_expressing > 0.5) n_majority,
    max(mean_expr) FILTER (excluded IS NULL) max_mean, quantile_cont(mean_expr, 0.5) FILTER (excluded IS NULL) median_mean,
    count(*) FILTER (excluded IS NULL) n_supported, count(*) FILTER (excluded IS NOT NULL) n_excluded FROM d_bulk GROUP BY 1) USING (gene))""")
def _(m):
    g = m.table("supplier").select(F.col("s_suppkey").alias("gene"))
    return rounded(design.distribution_summary(bulk(m), g.unionByName(g.select((F.col("gene") + 1000000).alias("gene"))), 0.55))


@query("three_way_sets", "SELECT gene, CAST(ct AS BIGINT) ct, side FROM d_sides")
def _(m):
    return rounded(sides(m).select("gene", "ct", "side"))


@query("threshold_sweep", """
SELECT gene, CAST(t AS DOUBLE) threshold, count(*) FILTER (excluded IS NULL AND pct_expressing >= t) n_positive,
  count(*) FILTER (excluded IS NULL AND pct_expressing <= t - 0.25) n_negative FROM d_bulk, (SELECT unnest([0.4::DOUBLE, 0.55::DOUBLE, 0.7::DOUBLE]) t) GROUP BY 1, 2""")
def _(m):
    return rounded(design.threshold_sweep(bulk(m), [0.4, 0.55, 0.7], 0.25))


@query("sibling_negatives", """
SELECT DISTINCT n.gene, CAST(n.ct AS BIGINT) ct FROM d_sides n JOIN t_edges a ON a.child = n.ct AND a.rel = 'is_a'
JOIN t_edges b ON b.parent = a.parent AND b.rel = 'is_a' JOIN d_sides p ON p.ct = b.child AND p.gene = n.gene
WHERE n.side = 'negative' AND p.side = 'positive'""")
def _(m):
    return rounded(design.sibling_negatives(sides(m), m.edges))


@query("same_tissue_negatives", """
SELECT gene, CAST(ct AS BIGINT) ct, tissue FROM d_sides WHERE side = 'negative' AND (gene, tissue) IN (SELECT (gene, tissue) FROM d_sides WHERE side = 'positive')""")
def _(m):
    return rounded(design.same_tissue_negatives(sides(m)))


@query("random_negatives", f"""
SELECT gene, CAST(ct AS BIGINT) ct, place FROM (SELECT gene, ct, row_number() OVER (PARTITION BY gene ORDER BY {h32("'3'", 'gene', 'ct')}, ct) place
  FROM d_sides WHERE side = 'negative') WHERE place <= 5""")
def _(m):
    return rounded(design.random_negatives(sides(m), 5, 3))


@query("contamination", " UNION ALL ".join(f"""
SELECT {s} AS share, gene, CAST(ct AS BIGINT) ct, side = 'negative' swapped FROM (
  SELECT *, least(floor(count(*) FILTER (side = 'positive') OVER (PARTITION BY gene) * {s} + 0.5), count(*) FILTER (side = 'negative') OVER (PARTITION BY gene)) k,
    row_number() OVER (PARTITION BY gene, side ORDER BY {h32("'9'", 'side', 'gene', 'ct')}, ct) r FROM d_sides WHERE side <> 'excluded')
WHERE CASE WHEN side = 'positive' THEN r > k ELSE r <= k END""" for s in ("0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE")))
def _(m):
    s = sides(m)
    parts = [design.contaminate(s, x, 9).select(F.lit(x).alias("share"), "gene", "ct", "swapped") for x in (0.25, 0.5, 0.75)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


TOK = "list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '))"
fragment("d_conv", f"""
SELECT a.conv_id, a.turn, {TOK.format('a.text')} ta, {TOK.format('b.text')} tb, row_number() OVER (ORDER BY a.turn, a.conv_id) r, count(*) OVER () n
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
fragment("d_null", """
SELECT round(len(list_intersect(x.ta, y.tb)) / CAST(len(x.ta) + len(y.tb) - len(list_intersect(x.ta, y.tb)) AS DOUBLE), 9) AS value
FROM d_conv x JOIN (SELECT unnest(range(1, 11)) s) ON TRUE JOIN d_conv y ON y.r = (x.r + s - 1) % x.n + 1 WHERE y.conv_id <> x.conv_id""")


@query("null_calibration", """
SELECT o.conv_id AS key, o.turn, o.v AS value, round((o.v - (SELECT avg(value) FROM d_null)) / (SELECT stddev_samp(value) FROM d_null), 4) z,
  round((SELECT count(*) FROM d_null n WHERE n.value < o.v) / CAST((SELECT count(*) FROM d_null) AS DOUBLE), 4) percentile,
  round(1 - (SELECT count(*) FROM d_null n WHERE n.value < o.v) / CAST((SELECT count(*) FROM d_null) AS DOUBLE), 4) p
FROM (SELECT conv_id, turn, round(len(list_intersect(ta, tb)) / CAST(len(ta) + len(tb) - len(list_intersect(ta, tb)) AS DOUBLE), 9) v FROM d_conv) o""")
def _(m):
    """Similarity of every two neighbouring turns of a conversation, against ten mismatches each."""
    from enrichspark.session import materialize

    turns = m.table("conversations").select("conv_id", "turn", F.array_distinct(F.split(normalise(F.col("text")), " ")).alias("ta"))
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ta").alias("tb"))
    pairs = materialize(turns.join(replies, ["conv_id", "turn"]), "turns")
    sim = F.round(jaccard(F.col("ta"), F.col("tb")), 9).alias("value")
    observed = pairs.select(F.struct("conv_id", "turn").alias("key"), sim)
    out = design.null_calibration(observed, design.mismatched(pairs, ["turn", "conv_id"], "conv_id", "ta", "tb", 10).select(sim))
    return out.select(F.col("key.conv_id").alias("key"), F.col("key.turn").alias("turn"), "value",
                      *[F.round(c, 4).alias(c) for c in ("z", "percentile", "p")])


@query("specificity", """
SELECT CAST(term AS BIGINT) term, count(DISTINCT ct) n_types, round(count(DISTINCT ct) / CAST((SELECT count(DISTINCT ct) FROM t_items) AS DOUBLE), 6) specificity
FROM t_carriers GROUP BY 1""")
def _(m):
    return rounded(design.specificity(m.carriers, m.items))


@query("collinear_features", """
WITH c AS (SELECT gene, kind, term, count(*) / CAST(any_value(n) AS DOUBLE) cv FROM t_obs JOIN t_features USING (item)
  JOIN (SELECT gene, count(*) n FROM t_obs WHERE value = 1 GROUP BY 1) USING (gene) WHERE value = 1 GROUP BY 1, 2, 3)
SELECT gene, kind, term, round(cv, 6) coverage FROM (SELECT *, max(cv) OVER (PARTITION BY gene) b FROM c) WHERE cv >= b - 0.05""")
def _(m):
    return rounded(design.collinear_features(m.obs, m.features))


@query("annotation_richness", """
SELECT gene, round(avg(r) FILTER (value = 1), 6) positive, round(avg(r) FILTER (value = 0), 6) negative,
  round(avg(r) FILTER (value = 1) - avg(r) FILTER (value = 0), 6) difference
FROM (SELECT gene, value, coalesce(n, 0) r FROM t_obs LEFT JOIN (SELECT item, count(*) n FROM t_features GROUP BY 1) USING (item) WHERE value IS NOT NULL) GROUP BY 1""")
def _(m):
    return rounded(design.annotation_richness(m.obs, m.features))
