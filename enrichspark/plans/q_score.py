"""Information content, scores, ceilings, floors, matches and transfer."""

from pyspark.sql import functions as F

from enrichspark.operators import matching, scoring, transfer
from enrichspark.operators.vocabulary import broad_vocabulary, with_every_term
from enrichspark.plans.model import ROOT
from enrichspark.plans.q_stats import rank_ora
from enrichspark.plans.registry import query, rounded
from enrichspark.plans.sql import fragment, h32, hyper_tail
from enrichspark.session import materialize


@query("information_content", "SELECT CAST(term AS BIGINT) term, round(ic, 6) ic FROM t_ic")
def _(m):
    return rounded(scoring.information_content(m.propagated))


@query("ic_of_unseen_terms", """
SELECT CAST(node AS BIGINT) term, round(coalesce(ic, ln((SELECT count(DISTINCT gene) FROM t_prop))), 6) ic
FROM (SELECT p_partkey node FROM part) LEFT JOIN t_ic ON term = node""")
def _(m):
    asked = m.table("part").select(F.col("p_partkey").alias("term"))
    return rounded(scoring.ic_of(asked, m.ic, m.propagated))


def f1_sql(o, p, t):
    return f"CASE WHEN {o} > 0 AND {p} > 0 AND {t} > 0 THEN 2 * {o} / ({p} + {t}) ELSE 0.0 END"


def scores_sql(source: str, keys: str) -> str:
    """Scores of rankings source(keys, term, rank), each prefix propagated on its own."""
    on = " AND ".join(f"t.{k} = m.{k}" for k in keys.split(", "))
    return f"""
SELECT {', '.join('m.' + k for k in keys.split(', '))}, truth_mass,
  any_value(np) n_predictions, {', '.join(f"max(CASE WHEN kk = {k} THEN f END) f1_at_{k}" for k in (1, 3, 5, 10))},
  sum(CASE WHEN kk <= 10 THEN f END) / 10 f1_mean_1_10
FROM (
  SELECT {', '.join('t.' + k for k in keys.split(', '))}, kk, truth_mass, any_value(np) np,
    {f1_sql('sum(CASE WHEN hit THEN ic ELSE 0 END)', 'sum(ic)', 'truth_mass')} f
  FROM (SELECT DISTINCT {', '.join('s.' + k for k in keys.split(', '))}, kk, anc, np FROM
          (SELECT *, count(*) OVER (PARTITION BY {keys}) np FROM ({source})) s
          JOIN (SELECT unnest(range(1, 11)) kk) ON s.rank <= kk JOIN t_closed ON src = s.term) t
  JOIN t_ic i ON i.term = t.anc JOIN t_mass USING (gene)
  LEFT JOIN (SELECT gene, term, TRUE hit FROM t_prop) p ON p.gene = t.gene AND p.term = t.anc
  GROUP BY {', '.join('t.' + k for k in keys.split(', '))}, kk, truth_mass) m
GROUP BY {', '.join('m.' + k for k in keys.split(', '))}, truth_mass""".replace("{on}", on)


fragment("t_scores", scores_sql("SELECT unit, gene, term, rank FROM t_rank_ora", "unit, gene"))
SCORE_COLUMNS = """n_predictions, round(truth_mass, 6) truth_mass, round(f1_at_1, 6) f1_at_1, round(f1_at_3, 6) f1_at_3,
  round(f1_at_5, 6) f1_at_5, round(f1_at_10, 6) f1_at_10, round(f1_mean_1_10, 6) f1_mean_1_10"""


@query("score_rankings", f"SELECT unit, gene, {SCORE_COLUMNS} FROM t_scores")
def _(m):
    return rounded(scoring.score_rankings(rank_ora(m), m.propagated, m.closed, m.ic, ["unit", "gene"]))


fragment("t_rank_effect", """
SELECT unit, gene, term, row_number() OVER (PARTITION BY unit, gene ORDER BY
    CASE WHEN p IS NULL THEN 2 ELSE 0 END, round(fold, 12) DESC NULLS LAST, p, term) AS rank
FROM (SELECT r.unit, r.gene, v.term, round(o.p, 10) p, o.fold FROM t_rates r CROSS JOIN t_vocab v
      LEFT JOIN t_ora o USING (unit, gene, term))""")
fragment("t_scores_both", scores_sql(
    "SELECT 'p' ranking, unit, gene, term, rank FROM t_rank_ora UNION ALL "
    "SELECT 'effect', unit, gene, term, rank FROM t_rank_effect", "ranking, unit, gene"))


@query("score_both_rankings", f"SELECT ranking, unit, gene, {SCORE_COLUMNS} FROM t_scores_both")
def _(m):
    return rounded(scoring.score_both_rankings(rank_ora(m), rank_ora(m, "effect"), m.propagated, m.closed, m.ic,
                                               ["unit", "gene"]))


fragment("t_scores_sig", scores_sql("""
SELECT unit, gene, term, row_number() OVER (PARTITION BY unit, gene ORDER BY rank) AS rank FROM t_rank_ora
SEMI JOIN (SELECT unit, gene, term FROM t_gscs WHERE significant) USING (unit, gene, term)""", "unit, gene"))


@query("significant_only_score", f"SELECT unit, gene, {SCORE_COLUMNS} FROM t_scores_sig")
def _(m):
    sig = m.tested.filter("significant")
    return rounded(scoring.significant_only_score(rank_ora(m), sig, m.propagated, m.closed, m.ic, ["unit", "gene"]))


# -- ceilings, by hand-unrolled greedy steps
fragment("t_va", "SELECT v.term v, anc, ic FROM t_vocab v JOIN t_closed ON src = v.term JOIN t_ic i ON i.term = anc WHERE ic > 0")
fragment("t_gv", f"""
SELECT *, {f1_sql('o', 'm', 'truth_mass')} f FROM (
  SELECT g.gene, truth_mass, v, sum(ic) m, sum(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) o
  FROM t_mass g CROSS JOIN t_va LEFT JOIN t_prop p ON p.gene = g.gene AND p.term = anc GROUP BY 1, 2, 3)""")


def greedy_step(name: str, before: str) -> None:
    """Fragments for one more greedy term: name(gene, f, m, o) and name_set(gene, anc)."""
    fragment(f"{name}_try", f"""
SELECT b.gene, b.truth_mass, b.f f0, t_va.v, b.m + sum(CASE WHEN s.anc IS NULL THEN ic ELSE 0 END) m2,
  b.o + sum(CASE WHEN s.anc IS NULL AND p.term IS NOT NULL THEN ic ELSE 0 END) o2
FROM {before} b CROSS JOIN t_va LEFT JOIN {before}_set s ON s.gene = b.gene AND s.anc = t_va.anc
LEFT JOIN t_prop p ON p.gene = b.gene AND p.term = t_va.anc GROUP BY b.gene, b.truth_mass, b.f, b.m, b.o, t_va.v""")
    fragment(f"{name}_best", f"""
SELECT gene, truth_mass, f0, v, m2, o2, f2 FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(-f2, 10), v) r
  FROM (SELECT *, {f1_sql('o2', 'm2', 'truth_mass')} f2 FROM {name}_try)) WHERE r = 1 AND f2 > f0 + 1e-12""")
    fragment(name, f"""
SELECT b.gene, b.truth_mass, coalesce(n.f2, b.f) f, coalesce(n.m2, b.m) m, coalesce(n.o2, b.o) o
FROM {before} b LEFT JOIN {name}_best n USING (gene)""")
    fragment(f"{name}_set", f"""
SELECT gene, anc FROM {before}_set UNION SELECT gene, anc FROM {name}_best JOIN t_va USING (v)""")


fragment("t_c0", "SELECT gene, truth_mass, 0.0 f, 0.0 m, 0.0 o FROM t_mass")
fragment("t_c0_set", "SELECT CAST(NULL AS BIGINT) gene, CAST(NULL AS INT) anc WHERE FALSE")
greedy_step("t_c1", "t_c0")
greedy_step("t_c2", "t_c1")
greedy_step("t_c3", "t_c2")
fragment("t_ceilings", """
SELECT g.gene, g.truth_mass, coalesce(reach / nullif(g.truth_mass, 0), 0.0) reachable_ic_fraction,
  coalesce(max_ic, 0.0) max_shared_ic, f1_top1, f1_top1_random, c.f f1_top3
FROM t_mass g JOIN (SELECT gene, max(f) f1_top1, sum(f) / (SELECT count(*) FROM t_vocab) f1_top1_random FROM t_gv GROUP BY 1) USING (gene)
JOIN t_c3 c USING (gene)
LEFT JOIN (SELECT gene, sum(ic) reach, max(ic) max_ic FROM t_prop p JOIN (SELECT DISTINCT anc, ic FROM t_va) ON p.term = anc
           GROUP BY 1) USING (gene)""")


def fresh_ceilings(m):
    return scoring.ceilings(m.propagated, m.vocabulary, m.closed, m.ic)


def model_ceilings(m):
    return m.shared("ceilings", lambda: fresh_ceilings(m))


@query("ceilings", """
SELECT gene, round(truth_mass, 6) truth_mass, round(reachable_ic_fraction, 6) reachable_ic_fraction,
  round(max_shared_ic, 6) max_shared_ic, round(f1_top1, 6) f1_top1, round(f1_top1_random, 6) f1_top1_random,
  round(f1_top3, 6) f1_top3 FROM t_ceilings""")
def _(m):
    return rounded(fresh_ceilings(m))


METRICS = ("reachable_ic_fraction", "max_shared_ic", "f1_top1", "f1_top1_random", "f1_top3")


@query("ceiling_summary", " UNION ALL ".join(f"""
SELECT '{c}' metric, round(quantile_cont({c}, 0.1), 6) q10, round(quantile_cont({c}, 0.25), 6) q25,
  round(quantile_cont({c}, 0.5), 6) q50, round(quantile_cont({c}, 0.75), 6) q75, round(quantile_cont({c}, 0.9), 6) q90,
  round(avg({c}), 6) AS mean, round(avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END), 6) frac_gt_0 FROM t_ceilings"""
                                             for c in METRICS))
def _(m):
    return rounded(scoring.summarize(model_ceilings(m), list(METRICS)))


@query("ceiling_by_carrying", """
SELECT gene IN (SELECT gene FROM t_prop WHERE term IN (SELECT term FROM t_vocab)) AS carrying, count(*) n_genes,
  round(quantile_cont(f1_top1, 0.5), 6) median_f1_top1, round(quantile_cont(max_shared_ic, 0.5), 6) median_max_shared_ic,
  round(avg(CASE WHEN max_shared_ic >= -ln(0.05) THEN 1.0 ELSE 0.0 END), 6) frac_ic_5,
  round(avg(CASE WHEN max_shared_ic >= -ln(0.01) THEN 1.0 ELSE 0.0 END), 6) frac_ic_1
FROM t_ceilings GROUP BY 1""")
def _(m):
    import math

    from enrichspark.functions.ordering import quantiles
    c = model_ceilings(m)
    carrying = m.propagated.join(m.vocabulary.select("term"), "term", "left_semi").select("gene").distinct()
    rows = (c.join(carrying.withColumn("_c", F.lit(True)), "gene", "left").withColumn("carrying", F.coalesce("_c", F.lit(False))))

    def share(cut):
        return F.avg(F.when(F.col("max_shared_ic") >= -math.log(cut), 1.0).otherwise(0.0))
    means = rows.groupBy("carrying").agg(F.count("*").alias("n_genes"), share(0.05).alias("frac_ic_5"), share(0.01).alias("frac_ic_1"))
    return rounded(means.join(quantiles(rows, "f1_top1", {"median_f1_top1": 0.5}, ["carrying"]), "carrying")
                   .join(quantiles(rows, "max_shared_ic", {"median_max_shared_ic": 0.5}, ["carrying"]), "carrying"))


N_DRAWS = 500
fragment("t_draws", f"""
SELECT draw, term FROM (
  SELECT draw, term, row_number() OVER (PARTITION BY draw ORDER BY {h32("'0'", "'draw'", 'draw', 'term')}, term) r
  FROM t_vocab, (SELECT unnest(range(1, {N_DRAWS} + 1)) draw)) WHERE r <= 3""")
fragment("t_draw_anc", "SELECT DISTINCT draw, anc, ic FROM t_draws d JOIN t_va ON v = d.term")
fragment("t_floor", f"""
SELECT gene, sum({f1_sql('o', 'm', 'truth_mass')}) / {N_DRAWS} AS floor FROM (
  SELECT g.gene, truth_mass, draw, sum(ic) m, sum(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) o
  FROM t_mass g CROSS JOIN t_draw_anc LEFT JOIN t_prop p ON p.gene = g.gene AND p.term = anc GROUP BY 1, 2, 3) GROUP BY 1""")


@query("floor_at_3", "SELECT gene, round(floor, 6) AS floor FROM t_floor")
def _(m):
    return rounded(scoring.floor_at_k(m.propagated, m.vocabulary, m.closed, m.ic, 3, N_DRAWS))


def headrooms(m):
    s = (scoring.score_rankings(rank_ora(m), m.propagated, m.closed, m.ic, ["unit", "gene"])
         .select("unit", "gene", "f1_at_3"))
    floors = scoring.floor_at_k(m.propagated, m.vocabulary, m.closed, m.ic, 3, N_DRAWS)
    tops = model_ceilings(m).select("gene", F.col("f1_top3").alias("ceiling"))
    return scoring.headroom(s, floors, tops, 3)


@query("headroom", """
SELECT unit, gene, round(f1_at_3, 6) f1_at_3, round(floor, 6) AS floor, round(f1_top3, 6) AS ceiling,
  round(CASE WHEN f1_top3 - floor > 1e-9 THEN (f1_at_3 - floor) / (f1_top3 - floor) END, 6) headroom_at_3
FROM t_scores JOIN t_floor USING (gene) JOIN t_ceilings USING (gene)""")
def _(m):
    return rounded(headrooms(m))


# -- constant prior: one greedy step per fragment over development genes
def prior_step(i: int) -> None:
    prev = " UNION ALL ".join(f"SELECT term FROM t_prior{j}" for j in range(1, i)) or "SELECT NULL AS term WHERE FALSE"
    fragment(f"t_prior{i}", f"""
SELECT term, s FROM (
 SELECT v term, avg({f1_sql('o', 'm', 'truth_mass')}) s FROM (
  SELECT g.gene, g.truth_mass, u.v, sum(ic) m, sum(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) o
  FROM (SELECT * FROM t_mass WHERE gene IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)) g CROSS JOIN (
    SELECT DISTINCT x.term v, a.anc, a.ic FROM t_vocab x JOIN t_va a ON a.v = x.term OR a.v IN ({prev})) u
  LEFT JOIN t_prop p ON p.gene = g.gene AND p.term = u.anc GROUP BY 1, 2, 3) GROUP BY 1)
{f"WHERE s > (SELECT max(s) FROM t_prior{i - 1}) + 1e-12" if i > 1 else ""}
ORDER BY round(s, 10) DESC, term LIMIT 1""")


for i in (1, 2, 3):
    prior_step(i)
fragment("t_prior", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rank, CAST(term AS BIGINT) term FROM t_prior{i}" for i in (1, 2, 3)))


def prior(m):
    dev = m.table("supplier").filter("s_nationkey < 8").select(F.col("s_suppkey").alias("gene"))
    return scoring.constant_prior(m.propagated, dev, m.vocabulary, m.closed, m.ic, 3)


@query("constant_prior", "SELECT rank, term FROM t_prior")
def _(m):
    return rounded(prior(m))


# -- ceiling null
fragment("t_pool", "SELECT i.term, ic FROM t_ic i JOIN (SELECT term, count(*) c FROM t_prop GROUP BY 1) USING (term) WHERE c >= 3 AND term <> 1")
fragment("t_null_turns", f"""
SELECT draw, list(options ORDER BY v) turns FROM (
  SELECT draw, v, list(term ORDER BY {h32("'7'", "'null'", 'draw', 'v', 'term')}) options
  FROM (SELECT t.term v, ic v_ic FROM t_vocab t JOIN t_ic USING (term)) x JOIN t_pool p ON abs(p.ic - v_ic) <= 0.25,
    (SELECT unnest(range(1, 21)) draw) GROUP BY 1, 2) GROUP BY 1""")
fragment("t_null_vocab", """
SELECT draw, unnest(list_reduce(turns, lambda used, t: list_concat(used, list_filter(t, lambda x: NOT list_contains(used, x))[1:1]),
  CAST([] AS INT[]))) term FROM t_null_turns""")


def null_vocabularies(m):
    vocab = m.vocabulary.select("term").join(m.ic, "term")
    pool = (m.propagated.groupBy("term").agg(F.count("*").alias("c")).filter(F.col("c") >= 3)
            .filter(F.col("term") != ROOT).join(m.ic, "term").select("term", "ic"))
    return scoring.matched_random_vocabularies(vocab, pool, 20, 7)


@query("matched_random_vocabularies", "SELECT CAST(draw AS BIGINT) draw, CAST(term AS BIGINT) term FROM t_null_vocab")
def _(m):
    return rounded(null_vocabularies(m))


@query("ceiling_null", f"""
WITH va AS (SELECT draw, v.term v, anc, ic FROM t_null_vocab v JOIN t_closed ON src = v.term JOIN t_ic i ON i.term = anc WHERE ic > 0),
f AS (SELECT draw, gene, max({f1_sql('o', 'm', 'truth_mass')}) f, max(mx) mx FROM (
  SELECT draw, g.gene, truth_mass, v, sum(ic) m, sum(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) o,
    max(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) mx
  FROM t_mass g CROSS JOIN va LEFT JOIN t_prop p ON p.gene = g.gene AND p.term = anc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
SELECT round(avg(a), 6) null_f1_top1, round(avg(b), 6) null_max_shared_ic FROM (
  SELECT draw, quantile_cont(f, 0.5) a, quantile_cont(mx, 0.5) b FROM f GROUP BY 1)""")
def _(m):
    from enrichspark.functions.ordering import quantiles
    vocabularies = materialize(null_vocabularies(m), "vocabularies")
    c = materialize(scoring.ceilings(m.propagated, vocabularies, m.closed, m.ic, ["draw"]).select("draw", "f1_top1", "max_shared_ic"), "ceilings")
    a = quantiles(c, "f1_top1", {"a": 0.5}, ["draw"])
    b = quantiles(c, "max_shared_ic", {"b": 0.5}, ["draw"])
    return rounded(a.join(b, "draw").agg(F.avg("a").alias("null_f1_top1"), F.avg("b").alias("null_max_shared_ic")))


@query("broad_vocabulary", """
SELECT CAST(term AS BIGINT) term, count(*) n_genes, round(any_value(ic), 6) ic FROM t_prop JOIN t_ic USING (term)
WHERE term <> 1 AND ic > 0 GROUP BY 1 HAVING count(*) >= 30""")
def _(m):
    return rounded(broad_vocabulary(m.propagated, m.ic, ROOT, 30))


@query("random_broad_reference", f"""
WITH bv AS (SELECT term FROM t_prop JOIN t_ic USING (term) WHERE term <> 1 AND ic > 0 GROUP BY 1 HAVING count(*) >= 30),
d AS (SELECT draw, term FROM (SELECT draw, term, row_number() OVER (PARTITION BY draw
        ORDER BY {h32("'5'", "'draw'", 'draw', 'term')}, term) r FROM bv, (SELECT unnest(range(1, 21)) draw)) WHERE r <= 3),
da AS (SELECT DISTINCT draw, anc, ic FROM d JOIN t_closed ON src = d.term JOIN t_ic i ON i.term = anc)
SELECT round(sum({f1_sql('o', 'm', 'truth_mass')}) / count(*), 6) mean_f1 FROM (
  SELECT g.gene, truth_mass, draw, sum(ic) m, sum(CASE WHEN p.term IS NOT NULL THEN ic ELSE 0 END) o
  FROM t_mass g CROSS JOIN da LEFT JOIN t_prop p ON p.gene = g.gene AND p.term = anc GROUP BY 1, 2, 3)""")
def _(m):
    vocab = broad_vocabulary(m.propagated, m.ic, ROOT, 30)
    f = scoring.floor_at_k(m.propagated, vocab, m.closed, m.ic, 3, 20, 5)
    return rounded(f.agg(F.avg("floor").alias("mean_f1")))


# -- transfer
MIN_TRANSFER = 10


def _assoc_sql(j, c, t, mm):
    return (f"CASE WHEN {j} > {c} * {t} / CAST({mm} AS DOUBLE) THEN least(300.0, -log10(greatest(1e-300, "
            f"{hyper_tail(j, mm, t, c)}))) ELSE 0.0 END")


fragment("t_joint", f"""
SELECT c, term, n_c, n_t, joint, (SELECT count(DISTINCT gene) FROM t_prop) mm FROM (
  SELECT a.term c, b.term, count(*) joint FROM t_prop a JOIN t_prop b ON a.gene = b.gene
  WHERE a.term IN (SELECT term FROM t_vocab) AND b.term IN (
    SELECT term FROM t_prop JOIN t_ic USING (term) WHERE ic > 0 AND term <> 1 GROUP BY 1 HAVING count(*) >= {MIN_TRANSFER})
  GROUP BY 1, 2)
JOIN (SELECT term c, count(*) n_c FROM t_prop GROUP BY 1) USING (c)
JOIN (SELECT term, count(*) n_t FROM t_prop GROUP BY 1) USING (term)""")
fragment("t_assoc", f"SELECT *, {_assoc_sql('joint', 'n_c', 'n_t', 'mm')} s FROM t_joint")
fragment("t_weights", """
SELECT unit, gene, term c, -log10(greatest(p, 1e-300)) w FROM t_corrected WHERE tested AND excess > 0 AND p < 1 - 1e-12""")
# leave one out by recomputing every count without the target
fragment("t_loo", f"""
SELECT unit, gene, c, w, term, {_assoc_sql('j1', 'c1', 't1', 'm1')} s FROM (
  SELECT w.unit, w.gene, w.c, w.w, j.term, joint - (CASE WHEN pc.gene IS NOT NULL AND pt.gene IS NOT NULL THEN 1 ELSE 0 END) j1,
    n_c - (CASE WHEN pc.gene IS NOT NULL THEN 1 ELSE 0 END) c1, n_t - (CASE WHEN pt.gene IS NOT NULL THEN 1 ELSE 0 END) t1,
    mm - (CASE WHEN w.gene IN (SELECT gene FROM t_prop) THEN 1 ELSE 0 END) m1
  FROM t_weights w JOIN t_joint j ON j.c = w.c LEFT JOIN t_prop pc ON pc.gene = w.gene AND pc.term = w.c
  LEFT JOIN t_prop pt ON pt.gene = w.gene AND pt.term = j.term)""")
fragment("t_transfer", """
SELECT unit, gene, term, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY unit, gene ORDER BY round(score, 9) DESC, term) AS rank FROM (
    SELECT unit, gene, term, sum(w * s) score FROM t_loo GROUP BY 1, 2, 3 HAVING sum(w * s) > 0)) WHERE rank <= 100""")


def assoc(m):
    return m.shared("associations", lambda: fresh_assoc(m))


def fresh_assoc(m):
    return transfer.associations(m.propagated, m.ic, m.vocabulary, ROOT, MIN_TRANSFER)


@query("coannotation_counts", "SELECT CAST(c AS BIGINT) c, CAST(term AS BIGINT) term, n_c, n_t, joint FROM t_joint")
def _(m):
    return rounded(fresh_assoc(m).select("c", "term", "n_c", "n_t", "joint"))


@query("transfer_association", "SELECT CAST(c AS BIGINT) c, CAST(term AS BIGINT) term, round(s, 5) s FROM t_assoc")
def _(m):
    return rounded(fresh_assoc(m).select("c", "term", "s"), 5)


@query("transfer_rank", """
SELECT unit, gene, CAST(term AS BIGINT) term, rank, round(score, 5) score FROM t_transfer""")
def _(m):
    w = transfer.evidence_weights(m.corrected)
    return rounded(transfer.transfer_rank(w, assoc(m), m.propagated, ["unit", "gene"]), 5)


@query("transfer_explain", """
WITH b AS (SELECT *, dense_rank() OVER (PARTITION BY unit, gene ORDER BY round(w, 9) DESC, c) c_rank FROM t_loo),
t AS (SELECT *, row_number() OVER (PARTITION BY unit, gene, c ORDER BY round(s, 9) DESC, term) t_rank FROM b WHERE s > 0)
SELECT unit, gene, CAST(c AS BIGINT) c, c_rank, round(w, 5) w, CAST(term AS BIGINT) term, t_rank, round(s, 5) assoc
FROM t WHERE c_rank <= 5 AND t_rank <= 5""")
def _(m):
    w = transfer.evidence_weights(m.corrected)
    return rounded(transfer.transfer_explain(w, assoc(m), m.propagated, ["unit", "gene"]), 5)


# -- matches
def classify_sql(preds: str, keys: str) -> str:
    """Classification of preds(keys, term); keys include gene."""
    k = ", ".join(f"p.{x}" for x in keys.split(", "))
    return f"""
SELECT {k}, p.term, d_up, d_down,
  CASE WHEN ex THEN 'exact' WHEN d_up IS NOT NULL THEN 'upward' WHEN d_down IS NOT NULL THEN 'downward' ELSE 'no_match' END kind,
  CASE WHEN ex THEN 0 WHEN d_up IS NOT NULL THEN d_up ELSE d_down END distance,
  CASE WHEN ex THEN NULL WHEN d_up IS NOT NULL THEN m_up ELSE m_down END matched_term, n_below, below
FROM (
  SELECT {k}, p.term, coalesce(bool_or(t.term = p.term), FALSE) ex,
    min(u.depth) d_up, arg_min(u.src, u.depth * 1000000 + u.src) m_up,
    min(d.depth) d_down, arg_min(d.anc, d.depth * 1000000 + d.anc) m_down,
    count(DISTINCT u.src) n_below, coalesce(array_to_string(list_sort(list(DISTINCT u.src) FILTER (u.src IS NOT NULL)), ','), '') below
  FROM (SELECT DISTINCT {keys}, term FROM ({preds})) p LEFT JOIN t_truth t ON t.gene = p.gene
  LEFT JOIN t_closed u ON u.src = t.term AND u.anc = p.term AND u.depth > 0
  LEFT JOIN t_closed d ON d.src = p.term AND d.anc = t.term AND d.depth > 0
  GROUP BY {k}, p.term) p"""


fragment("t_match", classify_sql("SELECT gene, term FROM t_rank_ora WHERE unit = 'cell_types'", "gene"))


def predictions(m):
    return rank_ora(m).filter("unit = 'cell_types'").select("gene", "term", "rank")


def fresh_matched(m):
    return matching.classify(predictions(m).drop("rank"), m.truths, m.closed)


def matched(m):
    return m.shared("matched", lambda: fresh_matched(m))


@query("classify_terms", """
SELECT gene, CAST(term AS BIGINT) term, kind, CAST(distance AS BIGINT) distance, CAST(matched_term AS BIGINT) matched_term,
  CASE WHEN kind = 'upward' THEN d_down IS NOT NULL END also_down FROM t_match""")
def _(m):
    return rounded(fresh_matched(m))


@query("relation_split", """
SELECT gene, CAST(term AS BIGINT) term, CASE WHEN kind IN ('exact', 'no_match') THEN kind WHEN d_down IS NULL THEN 'up_only'
    WHEN d_up IS NULL THEN 'only_down' WHEN d_down < d_up THEN 'both_down_closer' ELSE 'both_up_closer_or_equal' END split,
  CAST(d_up AS BIGINT) d_up, CAST(d_down AS BIGINT) d_down, n_below, below true_terms_below FROM t_match""")
def _(m):
    return rounded(matching.relation_split(predictions(m).drop("rank"), m.truths, m.closed, ["gene"]))


@query("distance_histogram", """
SELECT kind, CASE WHEN distance <= 3 THEN 'd=' || distance WHEN distance <= 5 THEN '3<d<=5' WHEN distance <= 10 THEN '5<d<=10'
  ELSE 'd>10' END AS bin, count(*) n FROM t_match WHERE kind IN ('upward', 'downward') GROUP BY 1, 2""")
def _(m):
    return matching.distance_histogram(matched(m))


fragment("t_match_genes", """
SELECT s_suppkey gene, count(*) FILTER (kind = 'exact') n_exact, count(*) FILTER (kind = 'upward') n_upward,
  count(*) FILTER (kind = 'downward') n_downward, count(*) FILTER (kind = 'no_match') n_no_match
FROM supplier LEFT JOIN t_match ON gene = s_suppkey GROUP BY 1""")


def match_genes(m):
    return matching.match_summary(matched(m), m.table("supplier").select(F.col("s_suppkey").alias("gene")))


@query("match_summary", "SELECT * FROM t_match_genes")
def _(m):
    return match_genes(m)


@query("match_totals", """
SELECT CAST(sum(n_exact) AS BIGINT) n_exact, CAST(sum(n_upward) AS BIGINT) n_upward, CAST(sum(n_downward) AS BIGINT) n_downward,
  CAST(sum(n_no_match) AS BIGINT) n_no_match, count(*) n_genes,
  round(avg(CASE WHEN n_exact + n_upward + n_downward + n_no_match = 0 THEN 1.0 ELSE 0.0 END), 6) frac_zero_predictions,
  round(sum(n_exact) / sum(n_exact + n_upward + n_downward + n_no_match), 6) frac_exact,
  round(sum(n_no_match) / sum(n_exact + n_upward + n_downward + n_no_match), 6) frac_no_match FROM t_match_genes""")
def _(m):
    return rounded(matching.summary_totals(match_genes(m)))


fragment("t_chance_match", classify_sql("SELECT DISTINCT t.gene, v.term FROM t_truth t, t_vocab v", "gene"))
fragment("t_chance", """
SELECT gene, avg(CASE WHEN kind <> 'no_match' THEN 1.0 ELSE 0.0 END) chance,
  avg(CASE WHEN kind = 'exact' THEN 1.0 ELSE 0.0 END) chance_exact, avg(CASE WHEN kind = 'upward' THEN 1.0 ELSE 0.0 END) chance_upward,
  avg(CASE WHEN kind = 'downward' THEN 1.0 ELSE 0.0 END) chance_downward,
  any_value(a) mean_true_ic, any_value(b) min_true_ic, any_value(c) max_true_ic
FROM t_chance_match JOIN (SELECT gene, avg(ic) a, min(ic) b, max(ic) c FROM t_truth JOIN t_ic USING (term) GROUP BY 1) USING (gene)
GROUP BY 1""")


def chance(m):
    return m.shared("chance", lambda: fresh_chance(m))


def fresh_chance(m):
    every = with_every_term(m.truths.select("gene").distinct(), m.vocabulary)
    return matching.chance_baseline(every, m.truths, m.closed, m.ic)


@query("chance_baseline", """
SELECT gene, round(chance, 6) chance, round(chance_exact, 6) chance_exact, round(chance_upward, 6) chance_upward,
  round(chance_downward, 6) chance_downward, round(mean_true_ic, 6) mean_true_ic, round(min_true_ic, 6) min_true_ic,
  round(max_true_ic, 6) max_true_ic FROM t_chance""")
def _(m):
    return rounded(fresh_chance(m))


@query("carrying_genes", "SELECT DISTINCT gene FROM t_truth WHERE gene IN (SELECT gene FROM t_prop WHERE term IN (SELECT term FROM t_vocab))")
def _(m):
    held = m.propagated.join(m.vocabulary.select("term"), "term", "left_semi")
    return m.truths.select("gene").distinct().join(held, "gene", "left_semi")
