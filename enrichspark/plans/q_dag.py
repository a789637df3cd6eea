"""Graph queries. Those on parts grow with the data; the term graph is read from part sizes."""

from pyspark.sql import functions as F

from enrichspark.operators import dag
from enrichspark.plans.registry import query, rounded
from enrichspark.plans.sql import fragment

fragment("p_edges", """
SELECT DISTINCT p_partkey child, p_partkey // 2 AS parent, 'is_a' rel FROM part WHERE p_partkey >= 2
UNION SELECT DISTINCT p_partkey, p_partkey // 3, 'part_of' FROM part WHERE p_partkey >= 3""")
fragment("p_starts", "SELECT child node FROM p_edges UNION SELECT parent FROM p_edges")
fragment("p_walk", """
SELECT node src, node anc, 0 depth FROM p_starts
UNION SELECT w.src, e.parent, w.depth + 1 FROM p_walk w JOIN p_edges e ON e.child = w.anc""", True)
fragment("p_walk_isa", """
SELECT node src, node anc, 0 depth FROM p_starts
UNION SELECT w.src, e.parent, w.depth + 1 FROM p_walk_isa w
JOIN p_edges e ON e.child = w.anc AND rel = 'is_a' WHERE w.depth < 4""", True)


def _part_terms(m):
    return m.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"),
        F.concat_ws(" ", "p_type", "p_brand").alias("definition"),
        F.when(F.col("p_partkey") % 97 == 0, "OBSOLETE").otherwise("OK").alias("status"))


fragment("p_terms", """
SELECT p_partkey id, p_name AS label, p_type || ' ' || p_brand AS definition,
       CASE WHEN p_partkey % 97 = 0 THEN 'OBSOLETE' ELSE 'OK' END status FROM part""")


@query("closure", "SELECT src, anc, CAST(min(depth) AS BIGINT) AS depth FROM p_walk GROUP BY 1, 2")
def _(m):
    return rounded(dag.closure(m.part_edges))


@query("closure_extended", "SELECT src, anc, CAST(min(depth) AS BIGINT) AS depth FROM p_walk GROUP BY 1, 2")
def _(m):
    """The closure without the edges of every tenth part, which are added afterwards."""
    added = F.col("child") % 10 == 0
    return rounded(dag.unpack(dag.extend_reach(dag.reach(m.part_edges.filter(~added)), m.part_edges.filter(added))))


@query("ancestors_limited", """
SELECT src, anc, CAST(min(depth) AS BIGINT) AS depth FROM p_walk_isa WHERE depth > 0 GROUP BY 1, 2""")
def _(m):
    """All is_a ancestors up to four edges away, without the node itself."""
    return rounded(dag.closure(m.part_edges, ("is_a",), 4).filter("depth > 0"))


@query("ancestor_depths", """
SELECT CAST(d AS BIGINT) AS depth, count(*) n_pairs FROM (SELECT src, anc, min(depth) d FROM p_walk GROUP BY 1, 2)
GROUP BY 1""")
def _(m):
    return rounded(dag.closure(m.part_edges).groupBy("depth").agg(F.count("*").alias("n_pairs")))


@query("propagate", "SELECT gene, CAST(term AS BIGINT) term FROM t_prop")
def _(m):
    return rounded(dag.propagate(m.truths, m.closed, ["gene"]))


@query("inherit_processes", """
SELECT src, CAST(process AS BIGINT) process, CAST(min(depth) AS BIGINT) AS depth FROM p_walk_isa
JOIN (SELECT p_partkey node, p_size process FROM part WHERE p_type = 'ECONOMY') ON anc = node WHERE depth <= 3
GROUP BY 1, 2""")
def _(m):
    capable = (m.table("part").filter("p_type = 'ECONOMY'")
               .select(F.col("p_partkey").alias("node"), F.col("p_size").alias("process")))
    return rounded(dag.inherit_processes(dag.closure(m.part_edges, ("is_a",), 3), capable))


@query("item_features", "SELECT item, kind, term, label FROM t_features")
def _(m):
    return m.features


@query("extract_subgraph", """
WITH asked AS (SELECT DISTINCT l_partkey + CASE WHEN l_quantity = 1 THEN 1000000000 ELSE 0 END id
               FROM lineitem),
reach AS (SELECT id, id AS found FROM asked UNION SELECT a.id, w.anc FROM asked a JOIN p_walk_isa w ON w.src = a.id)
SELECT found AS id, label, coalesce(status, 'NOT_FOUND') status, bool_or(r.id = found) requested
FROM reach r LEFT JOIN p_terms t ON t.id = found GROUP BY 1, 2, 3""")
def _(m):
    shifted = F.col("l_partkey") + F.when(F.col("l_quantity") == 1, 1000000000).otherwise(0)
    asked = m.table("lineitem").select(shifted.alias("id")).distinct()
    return dag.extract_subgraph(asked, _part_terms(m), dag.closure(m.part_edges, ("is_a",), 4))


@query("resolve_alternative_ids", """
SELECT DISTINCT l_partkey + 500 * (l_linenumber - 1) AS id,
  CASE WHEN p_partkey IS NOT NULL THEN l_partkey + 500 * (l_linenumber - 1)
       WHEN s_suppkey IS NOT NULL THEN s_suppkey + 0 END primary_id
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 500 * (l_linenumber - 1)
LEFT JOIN (SELECT s_suppkey, (SELECT max(p_partkey) FROM part) + 1 + s_suppkey alt FROM supplier)
  ON alt = l_partkey + 500 * (l_linenumber - 1)""")
def _(m):
    top = m.table("part").agg(F.max("p_partkey")).scalar()
    alt = m.table("supplier").select((top + 1 + F.col("s_suppkey")).alias("alt_id"), F.col("s_suppkey").alias("id"))
    ids = m.table("lineitem").select((F.col("l_partkey") + 500 * (F.col("l_linenumber") - 1)).alias("id")).distinct()
    return dag.resolve_alternative(ids, m.table("part").select(F.col("p_partkey").alias("id")), alt)


@query("resolve_terms", """
SELECT x.id, label, definition, coalesce(status, 'NOT_FOUND') status,
       coalesce(status, 'NOT_FOUND') = 'OK' AND label IS NOT NULL AS resolved
FROM (SELECT DISTINCT l_partkey * 2 AS id FROM lineitem) x LEFT JOIN p_terms t ON t.id = x.id""")
def _(m):
    ids = m.table("lineitem").select((F.col("l_partkey") * 2).alias("id")).distinct()
    return dag.resolve_terms(ids, _part_terms(m))


@query("resnik_similarity", """
WITH other AS (SELECT DISTINCT gene - 1 k, term FROM t_ann),
ks AS (SELECT gene k FROM t_truth UNION SELECT k FROM other)
SELECT ks.k AS key, round(coalesce(max(ic), 0.0), 6) resnik FROM ks
LEFT JOIN (SELECT p.gene k, ic FROM t_prop p JOIN (SELECT DISTINCT k, anc FROM other JOIN t_closed ON src = term) q
           ON q.k = p.gene AND q.anc = p.term JOIN t_ic i ON i.term = p.term) s ON s.k = ks.k GROUP BY 1""")
def _(m):
    """Each gene's truths against all annotations of the next gene."""
    other = m.annotations.select((F.col("gene") - 1).alias("key"), "term").distinct()
    return rounded(dag.resnik(m.truths.withColumnRenamed("gene", "key"), other, m.closed, m.ic))


@query("ontology_related_pairs", """
SELECT DISTINCT CAST(least(src, anc) AS BIGINT) term_a, CAST(greatest(src, anc) AS BIGINT) term_b FROM t_closed
WHERE depth > 0 AND src IN (SELECT term FROM t_truth) AND anc IN (SELECT term FROM t_truth)""")
def _(m):
    return rounded(dag.related_pairs(m.truths.select("term").distinct(), m.closed))


DEPTHS = (0, 1, 2, 3, 4, 6, 8)


@query("coverage_curve", """
WITH RECURSIVE walk AS (
  SELECT node src, node anc, 0 depth FROM p_starts
  UNION SELECT w.src, e.parent, w.depth + 1 FROM walk w JOIN p_edges e ON e.child = w.anc AND rel = 'is_a' WHERE w.depth < 8),
items AS (SELECT l_partkey ct, count(*) AS nr FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1),
held AS (SELECT d AS lvl, src, p_size process, any_value(i.nr) AS nr
  FROM walk JOIN (SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#7') ON anc = p_partkey
  JOIN items i ON i.ct = src JOIN (SELECT unnest([0, 1, 2, 3, 4, 6, 8]) d) ON depth <= d GROUP BY 1, 2, 3),
per_type AS (SELECT lvl, src, count(*) n, max(nr) AS nr FROM held GROUP BY 1, 2),
per_process AS (SELECT lvl, process, count(*) n FROM held GROUP BY 1, 2),
top AS (SELECT lvl, count(*) n_unique_terms, max(n) most_common_n,
        arg_min(process, -n * 1000 + process) most_common_term FROM per_process GROUP BY 1)
SELECT CAST(lvl AS BIGINT) AS depth, round(count(*) / (SELECT count(*) FROM items), 6) frac_cell_types,
  round(sum(nr) / (SELECT sum(nr) FROM items), 6) frac_rows, any_value(n_unique_terms) n_unique_terms,
  list_sort(list(n))[CAST(floor(count(*) / 2) AS INT) + 1] median_per_annotated,
  CAST(any_value(most_common_term) AS BIGINT) most_common_term, any_value(most_common_n) most_common_n
FROM per_type JOIN top USING (lvl) GROUP BY 1""")
def _(m):
    capable = (m.table("part").filter("p_brand = 'Brand#7'")
               .select(F.col("p_partkey").alias("node"), F.col("p_size").alias("process")))
    items = m.table("lineitem").select(F.col("l_partkey").alias("ct"), F.col("l_suppkey").alias("item")).distinct()
    return rounded(dag.coverage_curve(items, dag.closure(m.part_edges, ("is_a",), max(DEPTHS)), capable, DEPTHS))


@query("terms_per_item", """
WITH held AS (SELECT ps.gene item, ps.term FROM t_truth ps),
per AS (SELECT s_suppkey item, count(DISTINCT term) n FROM supplier LEFT JOIN held ON item = s_suppkey GROUP BY 1)
SELECT count(*) n_items, count(*) FILTER (n > 0) n_annotated, round(avg(n), 6) mean_all,
  round(avg(n) FILTER (n > 0), 6) mean_annotated, quantile_cont(n, 0.5) FILTER (n > 0) median_annotated,
  min(n) min_all, min(n) FILTER (n > 0) min_annotated, max(n) max_all,
  arg_min(item, -n * 1000000 + item) most_annotated, arg_min(item, n * 1000000 + item) FILTER (n > 0) least_annotated,
  (SELECT count(*) FROM (SELECT term FROM held GROUP BY 1 HAVING count(DISTINCT item) = 1)) n_single_carrier_terms
FROM per""")
def _(m):
    items = m.table("supplier").select(F.col("s_suppkey").alias("item"))
    held = m.truths.select(F.col("gene").alias("item"), "term")
    return rounded(dag.describe_terms_per_item(items, held))
