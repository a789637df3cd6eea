"""Named SQL fragments for the reference results, and their assembly into one statement.

They state the same tables as plans.model in plain relational SQL.
"""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}
RECURSIVE: set[str] = set()


def fragment(name: str, body: str, recursive: bool = False) -> None:
    FRAGMENTS[name] = body.strip()
    if recursive:
        RECURSIVE.add(name)


def compose(body: str) -> str:
    """Prefix a statement with the fragments it uses, directly or through other fragments."""
    names: list[str] = []

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if name not in names and re.search(rf"\b{name}\b", text):
                names.append(name)
                visit(FRAGMENTS[name])
    visit(body)
    # a fragment goes after everything it mentions
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in names:
            if other != name and re.search(rf"\b{other}\b", FRAGMENTS[name]):
                place(other)
        done.append(name)
    for n in names:
        place(n)
    if not done:
        return body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" if n not in RECURSIVE else f"{n} AS ({FRAGMENTS[n]})"
                      for n in done)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body.strip())
    rec = "RECURSIVE " if any(n in RECURSIVE for n in done) or (own and own.group(1)) else ""
    rest = f",\n{body.strip()[own.end():]}" if own else f"\n{body.strip()}"
    return f"WITH {rec}{head}{rest}"


fragment("t_nodes", """
SELECT DISTINCT CAST(node AS INT) node FROM (
  SELECT p_size node FROM part UNION ALL SELECT n_nationkey + 26 FROM nation)""")
fragment("t_edges", """
SELECT node child, CAST(node // 2 AS INT) parent, 'is_a' rel FROM t_nodes WHERE node >= 2
UNION ALL SELECT node, CAST(node // 3 AS INT), 'part_of' FROM t_nodes WHERE node >= 3""")
fragment("t_starts", "SELECT child node FROM t_edges UNION SELECT parent FROM t_edges")
fragment("t_walk", """
SELECT node src, node anc, 0 depth FROM t_starts
UNION SELECT w.src, e.parent, w.depth + 1 FROM t_walk w JOIN t_edges e ON e.child = w.anc""", True)
fragment("t_closed", "SELECT src, anc, min(depth) depth FROM t_walk GROUP BY 1, 2")
fragment("t_walk_isa", """
SELECT node src, node anc, 0 depth FROM t_nodes
UNION SELECT w.src, e.parent, w.depth + 1 FROM t_walk_isa w
JOIN t_edges e ON e.child = w.anc AND e.rel = 'is_a' WHERE w.depth < 3""", True)
fragment("t_isa3", "SELECT src, anc, min(depth) depth FROM t_walk_isa GROUP BY 1, 2")
fragment("t_terms", """
SELECT node id, 'term ' || node AS label, 'Definition of ' || node AS definition,
       CASE WHEN node % 17 = 0 THEN 'OBSOLETE' ELSE 'OK' END status FROM t_nodes""")
fragment("t_capable", "SELECT node, node process FROM t_nodes WHERE node <= 24 AND node % 4 <> 1")
fragment("t_carriers", """
SELECT DISTINCT src ct, process term FROM t_isa3 JOIN t_capable ON anc = node WHERE src >= 26""")
fragment("t_vocab", "SELECT term, count(DISTINCT ct) n_cell_types FROM t_carriers GROUP BY 1 HAVING count(DISTINCT ct) >= 3")
fragment("t_obs", """
SELECT l_suppkey gene, CAST(26 + c_nationkey AS INT) ct, c_mktsegment tissue,
       (26 + c_nationkey) || '|' || c_mktsegment item,
       CASE WHEN count(*) < 3 THEN NULL
            WHEN sum(CAST(round(l_discount * 100) AS BIGINT)) >= 7 * count(*) THEN 1 ELSE 0 END AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""")
fragment("t_units", """
SELECT 'cell_types' unit, gene, CAST(ct AS VARCHAR) item, ct, max(value) AS value FROM t_obs GROUP BY gene, ct
UNION ALL SELECT 'rows', gene, item, ct, value FROM t_obs""")
fragment("t_called", """
SELECT * FROM t_units WHERE value IS NOT NULL AND ct IN (SELECT ct FROM t_carriers)""")
fragment("t_rates", """
SELECT unit, gene, CAST(coalesce(sum(value), 0) AS BIGINT) n_pos, count(value) n_called,
       avg(CAST(value AS DOUBLE)) rate
FROM t_units WHERE ct IN (SELECT ct FROM t_carriers) GROUP BY 1, 2""")
fragment("t_evidence", """
SELECT unit, gene, term, count(*) size, CAST(sum(value) AS BIGINT) hits
FROM t_units JOIN t_carriers USING (ct) WHERE value IS NOT NULL AND term IN (SELECT term FROM t_vocab)
GROUP BY 1, 2, 3""")
fragment("t_baselines", """
SELECT unit, term, round(avg(hits / CAST(size AS DOUBLE)), 6) baseline, count(*) n_genes
FROM t_evidence GROUP BY 1, 2 HAVING count(*) >= 50""")
fragment("t_grand", "SELECT unit, round(avg(rate), 6) grand_mean FROM t_rates GROUP BY 1")
fragment("t_tissue_edges", """
SELECT DISTINCT c_mktsegment child, 'GROUP_' || (length(c_mktsegment) % 2) AS parent FROM customer
UNION SELECT DISTINCT 'GROUP_' || (length(c_mktsegment) % 2), 'ALL' FROM customer""")
fragment("t_tissue_walk", """
SELECT n src, n anc, 0 depth FROM (SELECT child n FROM t_tissue_edges UNION SELECT parent FROM t_tissue_edges)
UNION SELECT w.src, e.parent, w.depth + 1 FROM t_tissue_walk w JOIN t_tissue_edges e ON e.child = w.anc""", True)
fragment("t_items", "SELECT DISTINCT item, ct, tissue FROM t_obs")
fragment("t_features", """
SELECT DISTINCT item, kind, term, label FROM (
  SELECT item, 'lineage' kind, CAST(anc AS VARCHAR) term, label FROM t_items JOIN t_isa3 ON ct = src
    JOIN t_terms ON anc = id WHERE status = 'OK'
  UNION ALL
  SELECT item, 'process', CAST(term AS VARCHAR), label FROM t_items JOIN t_carriers USING (ct)
    JOIN t_terms ON term = id WHERE status = 'OK'
  UNION ALL SELECT item, 'tissue', anc, anc FROM t_items JOIN t_tissue_walk ON tissue = src)""")
fragment("t_features_v1", """
SELECT item, kind, term, label FROM t_features WHERE kind = 'lineage'
UNION ALL SELECT item, 'tissue', tissue, tissue FROM t_items""")
fragment("t_ann", """
SELECT l_suppkey gene, CAST(p_size AS INT) term, l_returnflag evidence
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
HAVING sum(CAST(round(l_discount * 100) AS BIGINT)) >= 8 * count(*)""")
fragment("t_truth", "SELECT DISTINCT gene, term FROM t_ann WHERE evidence <> 'R'")
fragment("t_prop", "SELECT DISTINCT t.gene, c.anc term FROM t_truth t JOIN t_closed c ON c.src = t.term")
fragment("t_ic", """
SELECT term, 0.0 - ln(count(*) / CAST((SELECT count(DISTINCT gene) FROM t_prop) AS DOUBLE)) ic FROM t_prop GROUP BY 1""")
fragment("t_mass", "SELECT gene, sum(ic) truth_mass FROM t_prop JOIN t_ic USING (term) GROUP BY 1")


def ln_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"


def hyper_tail(k: str, N: str, K: str, n: str) -> str:
    """P(X >= k) by summing probabilities from log factorials."""
    term = f"exp({ln_choose(K, 'i')} + {ln_choose(f'({N} - {K})', f'({n} - i)')} - {ln_choose(N, n)})"
    return (f"(CASE WHEN {k} <= greatest(0, {n} + {K} - {N}) THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform("
            f"range(CAST({k} AS BIGINT), CAST(least({K}, {n}) AS BIGINT) + 1), lambda i: {term})), 0.0)) END)")


def fisher(a: str, b: str, P: str, N: str) -> str:
    """Two-sided exact p by keeping tables no likelier than the observed one."""
    def lp(i: str) -> str:
        return f"({ln_choose(P, i)} + {ln_choose(N, f'({a} + {b} - {i})')} - {ln_choose(f'({P} + {N})', f'({a} + {b})')})"
    return (f"least(1.0, list_sum(list_transform(list_filter(range(CAST(greatest(0, {a} + {b} - {N}) AS BIGINT), "
            f"CAST(least({P}, {a} + {b}) AS BIGINT) + 1), lambda i: {lp('i')} <= {lp(a)} + 1e-7), lambda i: exp({lp('i')}))))")


def binomial(k: str, n: str, p: str) -> str:
    def lp(i: str) -> str:
        return f"({ln_choose(n, i)} + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p}))"
    return (f"least(1.0, list_sum(list_transform(list_filter(range(0, CAST({n} AS BIGINT) + 1), "
            f"lambda i: {lp('i')} <= {lp(k)} + 1e-7), lambda i: exp({lp('i')}))))")


def bh(p: str, family: str) -> str:
    """q-values of a table `ranked` that has _r and _m; to be used as a window over the family."""
    return (f"least(1.0, min({p} * _m / _r) OVER (PARTITION BY {family} ORDER BY _r DESC "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")


def h32(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
