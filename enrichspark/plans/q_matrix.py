"""Observation matrix queries."""

from pyspark.sql import functions as F

from enrichspark.operators import matrix
from enrichspark.plans.registry import query, rounded


@query("parse_pair", """
SELECT item, split_part(item, '|', 1) AS ct, split_part(item, '|', 2) AS tissue, count(*) n_genes
FROM t_obs GROUP BY 1, 2, 3""")
def _(m):
    ct, tissue = matrix.parse_pair(F.col("item"))
    return m.obs.groupBy("item", ct.alias("ct"), tissue.alias("tissue")).agg(F.count("*").alias("n_genes"))


@query("positive_items", "SELECT gene, item FROM t_obs WHERE value = 1")
def _(m):
    return matrix.positive_items(m.obs).select("gene", "item")


@query("negative_items", "SELECT gene, item FROM t_obs WHERE value = 0")
def _(m):
    return matrix.negative_items(m.obs).select("gene", "item")


SUMMARY = """
SELECT gene, count(*) FILTER (value = 1) n_positive, count(*) FILTER (value = 0) n_negative,
       (SELECT count(DISTINCT item) FROM t_obs) - count(value) n_missing,
       (SELECT count(DISTINCT item) FROM t_obs) n_total
FROM t_obs GROUP BY 1"""


@query("expression_summary", SUMMARY)
def _(m):
    return matrix.expression_summary(m.obs)


@query("rank_by_missing", f"""
SELECT gene, n_missing, round(n_positive / n_total, 6) positive_ratio, row_number() OVER (ORDER BY n_missing, gene) AS rank FROM ({SUMMARY})
WHERE n_positive / n_total <= 0.07""")
def _(m):
    return rounded(matrix.rank_by_missing(m.obs, 0.07).select("gene", "n_missing", "positive_ratio", "rank"))


@query("rollup_cell_types", "SELECT gene, CAST(ct AS BIGINT) ct, CAST(max(value) AS BIGINT) AS value FROM t_obs GROUP BY gene, ct")
def _(m):
    return rounded(matrix.rollup_items(m.obs))


@query("gene_rates", "SELECT unit, gene, n_pos, n_called, round(rate, 6) rate FROM t_rates")
def _(m):
    return rounded(m.rates)


@query("presence_check", """
SELECT s_suppkey gene, CASE WHEN s_suppkey IN (SELECT gene FROM t_obs) THEN 'present' ELSE 'absent' END status
FROM supplier UNION ALL
SELECT 1000000000 + s_suppkey, 'absent' FROM supplier""")
def _(m):
    s = m.table("supplier").select(F.col("s_suppkey").alias("gene"))
    asked = s.unionByName(s.select((F.col("gene") + 1000000000).alias("gene")))
    return matrix.presence_check(asked, m.obs)
