"""Comparisons, donors, samples and run bookkeeping. Events act as runs, labels as verdicts, customers as a population."""

from pyspark.sql import functions as F

from enrichspark.operators import compare, coverage, donors, matching, runs, sampling, scoring
from enrichspark.plans.q_score import SCORE_COLUMNS, classify_sql, model_ceilings, predictions, scores_sql
from enrichspark.plans.q_stats import rank_ora
from enrichspark.plans.registry import query, rounded
from enrichspark.plans.sql import fragment, h32
from enrichspark.session import materialize

N_BOOT = 10_000
N_GROUP_BOOT = 2_000
N_STRATUM_BOOT = 300


def boot_sql(source: str, keys: str, value: str, n_boot: int, seed: int = 0) -> str:
    """Bootstrap means of source(keys, gene, value) per boot, one row per draw."""
    def mixed(a: str, b: str, c: str) -> str:
        return f"""
  SELECT *, xor(y, y >> 16) {c} FROM (SELECT *, (xor(x, x >> 13) * 69621 + {b}) % 2147483647 y FROM (
    SELECT *, (xor({a}, {b}) * 48271 + 11) % 2147483647 x FROM"""
    return f"""
SELECT {keys}, boot, sum(vs[draw % n + 1]) / any_value(n) AS mean FROM ({mixed('own', 'slot', 'draw')} (
  SELECT {keys}, boot, n, vs, own, unnest(range(n)) * 22695477 % 2147483647 slot FROM ({mixed('h', 'b', 'own')} (
    SELECT {keys}, n, vs, h, boot, CAST(boot AS BIGINT) * 1664525 % 2147483647 b FROM (
      SELECT {keys}, list({value} ORDER BY gene) vs, count(*) n, {h32(f"'{seed}'", keys)} % 2147483647 h FROM ({source}) WHERE {value} IS NOT NULL GROUP BY {keys}),
      (SELECT unnest(range(1, {n_boot} + 1)) boot)))))))))
GROUP BY {keys}, boot"""


def ci_sql(boots: str, keys: str, n_boot: int) -> str:
    return f"""
SELECT {keys}, quantile_cont(mean, 0.025) ci_lo, quantile_cont(mean, 0.975) ci_hi,
  least(1.0, greatest(2 * least(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END)),
        1.0 / ({n_boot} + 1))) p
FROM ({boots}) WHERE mean IS NOT NULL GROUP BY {keys}"""


fragment("e_scores", "SELECT event_type condition, user_id gene, avg(value) score FROM events GROUP BY 1, 2")
fragment("e_contrasts", """
SELECT * FROM (VALUES ('a1', 'click', 'view'), ('a2', 'purchase', 'signup'), ('a3', 'error', 'click'),
  ('a4', 'purchase', 'view'), ('a5', 'click', 'absent')) t(contrast, a, b)""")
fragment("e_diffs", """
SELECT contrast, x.gene, x.score - y.score d FROM e_contrasts JOIN e_scores x ON x.condition = a
JOIN e_scores y ON y.condition = b AND y.gene = x.gene""")


def event_scores(m):
    return m.table("events").groupBy(F.col("event_type").alias("condition"), F.col("user_id").alias("gene")) \
            .agg(F.avg("value").alias("score"))


def contrasts(m):
    return m.spark.createDataFrame([("a1", "click", "view"), ("a2", "purchase", "signup"), ("a3", "error", "click"),
                                    ("a4", "purchase", "view"), ("a5", "click", "absent")], "contrast string, a string, b string")


@query("paired_conditions", "SELECT contrast, gene, round(d, 6) d FROM e_diffs")
def _(m):
    return rounded(compare.paired(event_scores(m), contrasts(m)))


@query("paired_bootstrap", f"""
WITH ci AS ({ci_sql(boot_sql('SELECT * FROM e_diffs', 'contrast', 'd', N_BOOT), 'contrast', N_BOOT)}),
r AS (SELECT contrast, n, mean_diff, ci_lo, ci_hi, p, row_number() OVER (ORDER BY p) _r, count(*) OVER () _m FROM (
  SELECT contrast, count(*) n, avg(d) mean_diff FROM e_diffs GROUP BY 1 HAVING count(*) >= 3) JOIN ci USING (contrast))
SELECT contrast, n, round(mean_diff, 6) mean_diff, round(ci_lo, 6) ci_lo, round(ci_hi, 6) ci_hi, round(p, 6) p,
  round(least(1.0, max((_m - _r + 1) * p) OVER (ORDER BY _r)), 6) p_holm FROM r""")
def _(m):
    return rounded(compare.paired_bootstrap(event_scores(m), contrasts(m), N_BOOT))


@query("means_table", f"""
WITH ci AS ({ci_sql(boot_sql('SELECT * FROM e_scores', 'condition', 'score', N_BOOT), 'condition', N_BOOT)})
SELECT condition, count(*) n, round(avg(score), 6) AS mean, round(any_value(ci_lo), 6) ci_lo, round(any_value(ci_hi), 6) ci_hi
FROM e_scores JOIN ci USING (condition) GROUP BY 1 HAVING count(*) >= 2""")
def _(m):
    return rounded(compare.means_table(event_scores(m), N_BOOT))


fragment("e_gate_diffs", """
SELECT rung || '|' || side contrast, x.gene, x.score - y.score d FROM (
  SELECT rung, 'vs_prior' side, 'click' b FROM (VALUES ('purchase', 'view'), ('signup', 'error')) t(rung, control)
  UNION ALL SELECT rung, 'vs_mismatched', control FROM (VALUES ('purchase', 'view'), ('signup', 'error')) t(rung, control))
JOIN e_scores x ON x.condition = rung JOIN e_scores y ON y.condition = b AND y.gene = x.gene""")
fragment("e_gate", f"""
SELECT split_part(contrast, '|', 1) rung, max(CASE WHEN contrast LIKE '%vs_prior' THEN ci_lo END) ci_lo_prior,
  max(CASE WHEN contrast LIKE '%vs_mismatched' THEN ci_lo END) ci_lo_mismatched
FROM ({ci_sql(boot_sql('SELECT * FROM e_gate_diffs', 'contrast', 'd', N_BOOT), 'contrast', N_BOOT)}) GROUP BY 1""")


def gate(m):
    rungs = m.spark.createDataFrame([("purchase", "view"), ("signup", "error")], "rung string, control string")
    return compare.signal_gate(event_scores(m), rungs, "click", N_BOOT)


@query("signal_gate", """
SELECT rung, round(ci_lo_prior, 6) ci_lo_prior, round(ci_lo_mismatched, 6) ci_lo_mismatched,
  ci_lo_prior > 0 AND ci_lo_mismatched > 0 passes FROM e_gate""")
def _(m):
    return rounded(gate(m))


@query("signal_verdict", """
SELECT CASE WHEN bool_or(ci_lo_prior > 0 AND ci_lo_mismatched > 0) THEN 'SIGNAL DETECTED' ELSE 'INCONCLUSIVE' END verdict,
  count(*) FILTER (ci_lo_prior > 0 AND ci_lo_mismatched > 0) n_passing FROM e_gate""")
def _(m):
    return compare.verdict(gate(m))


# -- donors, checked against all pairs
def donors_sql(source: str, k: int, seed: int = 42) -> str:
    pos = f"CAST('0x' || substr(md5('{seed}|' || gene), 1, 15) AS BIGINT)"
    return f"""
SELECT gene, donor, unnest(range(place, {k} + 1, n)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY gene) n FROM (
  SELECT a.gene, b.gene donor, row_number() OVER (PARTITION BY a.gene
    ORDER BY (CAST(b.pos AS HUGEINT) - a.pos + 1152921504606846976) % 1152921504606846976, b.gene) place
  FROM (SELECT gene, CAST(round(rate * 1000000) AS BIGINT) r, {pos} pos FROM ({source})) a
  JOIN (SELECT gene, CAST(round(rate * 1000000) AS BIGINT) r, {pos} pos FROM ({source})) b
    ON a.gene <> b.gene AND abs(a.r - b.r) <= 50000) WHERE place <= {k})"""


fragment("t_donors", donors_sql("SELECT gene, rate FROM t_rates WHERE unit = 'cell_types' AND rate IS NOT NULL", 1))
fragment("c_rates", "SELECT c_custkey gene, round((c_acctbal + 1000) / 12000, 4) rate FROM customer")


def gene_donors(m, k=1):
    return donors.ring_donors(m.rates.filter("unit = 'cell_types'").select("gene", "rate"), 0.05, k)


@query("choose_donors", "SELECT gene, donor FROM t_donors")
def _(m):
    return gene_donors(m).select("gene", "donor")


@query("shuffled_donors", donors_sql("SELECT * FROM c_rates", 5))
def _(m):
    c = m.table("customer").select(F.col("c_custkey").alias("gene"), F.round((F.col("c_acctbal") + 1000) / 12000, 4).alias("rate"))
    return rounded(donors.ring_donors(c, 0.05, 5))


fragment("t_mismatched_scores", scores_sql(
    "SELECT d.gene, r.term, r.rank FROM t_donors d JOIN t_rank_ora r ON r.gene = d.donor AND r.unit = 'cell_types'", "gene"))


@query("mismatched_evidence_scores", f"SELECT gene, {SCORE_COLUMNS} FROM t_mismatched_scores")
def _(m):
    shown = rank_ora(m).filter("unit = 'cell_types'").select("gene", "term", "rank")
    borrowed = donors.mismatched_evidence(shown, gene_donors(m), ["gene"])
    return rounded(scoring.score_rankings(borrowed, m.propagated, m.closed, m.ic, ["gene"]))


fragment("t_donors5", donors_sql("SELECT gene, rate FROM t_rates WHERE unit = 'cell_types' AND rate IS NOT NULL", 5))
fragment("t_shuffled_match", classify_sql("""
SELECT d.gene AS target, d.donor AS gene, d.place, r.term FROM t_donors5 d JOIN t_rank_ora r ON r.gene = d.gene AND unit = 'cell_types'""", "target, gene, place"))


@query("shuffled_baseline", """
WITH k AS (SELECT s.target, s.place, kind, kind <> 'no_match' hit, rank FROM t_shuffled_match s
  JOIN t_rank_ora r ON r.gene = s.target AND r.term = s.term AND unit = 'cell_types'),
d AS (SELECT target, place, count(*) FILTER (kind = 'exact') e, count(*) FILTER (kind = 'upward') u, count(*) FILTER (kind = 'downward') w,
  count(*) FILTER (NOT hit) n, max(CASE WHEN hit THEN 1 ELSE 0 END) am, max(CASE WHEN kind = 'exact' THEN 1 ELSE 0 END) ae,
  max(CASE WHEN hit AND rank <= 3 THEN 1 ELSE 0 END) m3 FROM k GROUP BY 1, 2)
SELECT s_suppkey target, round(avg(e), 6) shuffled_exact, round(avg(u), 6) shuffled_upward, round(avg(w), 6) shuffled_downward, round(avg(n), 6) shuffled_no_match,
  round(avg(am), 6) shuffled_any_match, round(avg(ae), 6) shuffled_any_exact, round(avg(m3), 6) shuffled_match_at_3
FROM supplier LEFT JOIN d ON target = s_suppkey GROUP BY 1""")
def _(m):
    # classify reads its rows more than once: written out, so that the ranking and the ring are made once
    rows = materialize(donors.shuffled_baseline(predictions(m), gene_donors(m, 5)), "donated")
    kinds = matching.classify(rows, m.truths, m.closed, ["target", "gene", "place"])
    return rounded(donors.shuffled_rates(kinds, m.table("supplier").select(F.col("s_suppkey").alias("gene"))))


# -- samples and splits
fragment("t_eligible", """
SELECT s_suppkey gene, n_direct_terms, rate, room, CASE WHEN s_suppkey < 3 THEN 'smoke' WHEN room IS NULL THEN 'excluded:not_scoreable'
  WHEN n_direct_terms < 5 THEN 'excluded:sparse_annotation' WHEN rate IS NULL OR rate NOT BETWEEN 0.1 AND 0.4 THEN 'excluded:rate_out_of_range' END early
FROM supplier LEFT JOIN (SELECT gene, rate FROM t_rates WHERE unit = 'cell_types') r ON r.gene = s_suppkey
LEFT JOIN (SELECT gene, count(*) n_direct_terms FROM t_truth GROUP BY 1) t ON t.gene = s_suppkey
LEFT JOIN (SELECT gene, round(f1_top1 - f1_top1_random, 8) room FROM t_ceilings) c ON c.gene = s_suppkey""")


@query("eligibility", """
SELECT gene, coalesce(early, CASE WHEN room < (SELECT quantile_cont(room, 0.25) FROM t_eligible WHERE early IS NULL)
  THEN 'excluded:low_room' ELSE 'eligible' END) status FROM t_eligible""")
def _(m):
    g = (m.table("supplier").select(F.col("s_suppkey").alias("gene"))
         .join(m.rates.filter("unit = 'cell_types'").select("gene", "rate"), "gene", "left")
         .join(m.truths.groupBy("gene").agg(F.count("*").alias("n_direct_terms")), "gene", "left")
         .join(model_ceilings(m).select("gene", F.round(F.col("f1_top1") - F.col("f1_top1_random"), 8).alias("room")), "gene", "left"))
    return sampling.eligibility(g, F.col("gene") < 3, 5, 0.1, 0.4).select("gene", "status")


@query("stratum", """
SELECT s_suppkey gene, CASE WHEN s_suppkey NOT IN (SELECT gene FROM t_prop) THEN 'unscoreable'
  WHEN s_suppkey IN (SELECT gene FROM t_prop WHERE term = 24) THEN 'carrying' ELSE 'not_carrying' END stratum FROM supplier""")
def _(m):
    genes = m.table("supplier").select(F.col("s_suppkey").alias("gene"))
    return sampling.stratum(genes, m.propagated, m.nodes.filter("node = 24").select(F.col("node").alias("term")))


@query("hash_split", """
SELECT gene, stratum, position, CASE WHEN stratum = 'carrying' THEN CASE WHEN position <= 40 THEN 'dev' WHEN position <= 160 THEN 'test'
  ELSE 'held' END ELSE CASE WHEN position <= 30 THEN 'test' ELSE 'held' END END split FROM (
  SELECT gene, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('salt-1|' || gene)) position FROM (
    SELECT c_custkey gene, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_carrying' ELSE 'carrying' END stratum FROM customer))""")
def _(m):
    g = m.table("customer").select(F.col("c_custkey").alias("gene"), F.when(
        F.col("c_mktsegment") == "BUILDING", "not_carrying").otherwise("carrying").alias("stratum"))
    return rounded(sampling.split_by_hash(g, "salt-1").select("gene", "stratum", "position", "split"))


fragment("t_sample", f"""
SELECT gene, item, ct, is_positive, row_number() OVER (PARTITION BY gene ORDER BY {h32("'0'", "'mix'", 'gene', 'item')}, item) - 1 AS index FROM (
  SELECT gene, item, ct, value = 1 is_positive, row_number() OVER (PARTITION BY gene, value ORDER BY {h32("'0'", 'gene', 'item')}, item) r
  FROM t_obs WHERE value IS NOT NULL) WHERE r <= 40""")


@query("balanced_sample", "SELECT gene, item, is_positive, index FROM t_sample")
def _(m):
    return rounded(sampling.balanced_sample(m.obs, 40).select("gene", "item", "is_positive", "index"))


@query("sample_overlap_rate", """
SELECT gene, count(*) FILTER (is_positive) n_positive, count(*) FILTER (NOT is_positive) n_negative, count(DISTINCT ct) n_cell_types,
  round(avg(CASE WHEN mixed THEN 1.0 ELSE 0.0 END), 6) overlap_rate
FROM t_sample JOIN (SELECT gene, ct, min(value) <> max(value) mixed FROM t_obs WHERE value IS NOT NULL GROUP BY 1, 2) USING (gene, ct)
GROUP BY 1""")
def _(m):
    return rounded(sampling.overlap_rate(sampling.balanced_sample(m.obs, 40), m.obs))


fragment("c_ring", f"""
SELECT gene, ok, row_number() OVER (ORDER BY {h32("'42'", "'ring'", 'gene')}, gene) at_, count(*) OVER () n FROM (
  SELECT c_custkey gene, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ok FROM customer)""")


@query("distractor_genes", """
SELECT gene, donor, CAST(place AS BIGINT) place, CAST(redraws AS BIGINT) redraws FROM (
  SELECT a.gene, b.gene donor, b.ok, sum(CASE WHEN b.ok THEN 1 ELSE 0 END) OVER w place,
    sum(CASE WHEN b.ok THEN 0 ELSE 1 END) OVER w redraws
  FROM c_ring a JOIN (SELECT unnest(range(1, 15)) step) ON step < a.n JOIN c_ring b ON b.at_ = (a.at_ + step - 1) % a.n + 1
  WINDOW w AS (PARTITION BY a.gene ORDER BY step)) WHERE ok AND place <= 3 AND redraws <= 10""")
def _(m):
    genes = m.table("customer").select(F.col("c_custkey").alias("gene"))
    ann = m.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("gene"))
    return rounded(sampling.distractor_genes(genes, ann))


@query("distractor_terms", """
SELECT d.gene, d.donor, CAST(term AS BIGINT) term FROM t_donors5 d JOIN (
  SELECT gene, term, row_number() OVER (PARTITION BY gene ORDER BY term) r FROM t_truth) t ON t.gene = d.donor WHERE r <= 10""")
def _(m):
    return rounded(sampling.distractor_terms(gene_donors(m, 5), m.truths))


@query("run_seed", """
SELECT event_id run_id, xor(CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT), 42) seed FROM events""")
def _(m):
    return m.table("events").select(F.col("event_id").alias("run_id"), sampling.run_seed(F.col("event_id"), 42).alias("seed"))


# -- runs
fragment("e_runs", """
SELECT event_id run_id, user_id gene, ts start_time, value score, k,
  CASE WHEN event_type = 'error' THEN ['click', 'view', 'purchase', 'signup'][event_id % 4 + 1] ELSE event_type END condition,
  CASE WHEN event_type = 'error' THEN 'FAILED_PARSE' WHEN event_id % 13 = 0 THEN 'FAILED_BLINDING'
       WHEN event_id % 11 = 0 THEN 'UNFINISHED' ELSE 'COMPLETED' END status,
  'h' || (k % 3) code_hash, CASE user_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'smoke' END split,
  event_id % 7 = 0 unfrozen, k % 10 = 0 abstained, CASE WHEN k % 5 <> 0 THEN 'p' || k END property, 'm' || (event_id % 2) model,
  k % 11 n_valid, k % 4 n_invalid, k % 3 n_duplicate, least(k % 11, k % 6) n_in_table, event_id % 5 repeat_
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) k FROM events)""")


def event_runs(m):
    e = m.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup")])
    eid, k, user = F.col("event_id"), F.col("k"), F.col("user_id")
    bad = F.col("event_type") == "error"
    return e.select(
        eid.alias("run_id"), user.alias("gene"), F.col("ts").alias("start_time"), F.col("value").alias("score"), "k",
        F.when(bad, F.element_at(names, (eid % 4 + 1).cast("int"))).otherwise(F.col("event_type")).alias("condition"),
        F.when(bad, "FAILED_PARSE").when(eid % 13 == 0, "FAILED_BLINDING").when(eid % 11 == 0, "UNFINISHED")
        .otherwise("COMPLETED").alias("status"),
        F.concat(F.lit("h"), k % 3).alias("code_hash"),
        F.when(user % 3 == 0, "test").when(user % 3 == 1, "dev").otherwise("smoke").alias("split"),
        (eid % 7 == 0).alias("unfrozen"), (k % 10 == 0).alias("abstained"),
        F.when(k % 5 != 0, F.concat(F.lit("p"), k)).alias("property"), F.concat(F.lit("m"), eid % 2).alias("model"),
        (k % 11).alias("n_valid"), (k % 4).alias("n_invalid"), (k % 3).alias("n_duplicate"),
        F.least(k % 11, k % 6).alias("n_in_table"), (eid % 5).alias("repeat"))


def current():
    return F.col("code_hash") == "h1"


@query("latest_run", """
SELECT condition, gene, arg_max(run_id, (start_time, run_id)) run_id, arg_max(status, (start_time, run_id)) status
FROM e_runs GROUP BY 1, 2""")
def _(m):
    return runs.latest_run(event_runs(m), ["condition", "gene"]).select("condition", "gene", "run_id", "status")


fragment("e_best", """
SELECT gene, run_id, status, code_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY status = 'COMPLETED' DESC, code_hash = 'h1' DESC, start_time DESC, run_id DESC) r
  FROM e_runs) WHERE r = 1""")


def best(m):
    return runs.best_run(event_runs(m), current(), ["gene"])


@query("best_run", "SELECT gene, run_id, status, code_hash FROM e_best")
def _(m):
    return best(m).select("gene", "run_id", "status", "code_hash")


@query("missing_reason", """
SELECT c_custkey gene, CASE WHEN status IS NULL THEN 'no run yet' WHEN status = 'COMPLETED' AND code_hash = 'h1' THEN 'done'
  WHEN status = 'COMPLETED' THEN 'completed under older code' WHEN status = 'FAILED_BLINDING' THEN 'failed blinding'
  WHEN status = 'FAILED_PARSE' THEN 'failed parse' ELSE 'not finished' END reason
FROM customer LEFT JOIN e_best ON gene = c_custkey""")
def _(m):
    genes = m.table("customer").select(F.col("c_custkey").alias("gene"))
    return runs.missing_reason(genes, best(m), current()).select("gene", "reason")


@query("missing_genes", """
SELECT c_custkey gene FROM customer WHERE c_custkey NOT IN (SELECT gene FROM e_runs WHERE status = 'COMPLETED')""")
def _(m):
    done = event_runs(m).filter("status = 'COMPLETED'").select("gene")
    return m.table("customer").select(F.col("c_custkey").alias("gene")).join(done, "gene", "left_anti")


@query("select_runs", """
SELECT run_id, gene, round(score, 6) score FROM e_runs WHERE status = 'COMPLETED' AND split = 'test' AND condition = 'click'""")
def _(m):
    return rounded(runs.select_runs(event_runs(m), "COMPLETED", "test", "click").orderBy("start_time").select("run_id", "gene", "score"))


fragment("e_marked", """
SELECT r.*, CASE WHEN code_hash <> ref THEN 'other_code' WHEN unfrozen AND split = 'test' THEN 'unfrozen' END drop_reason
FROM e_runs r JOIN (VALUES ('click', 'h0'), ('view', 'h1'), ('purchase', 'h2'), ('signup', 'h0')) t(condition, ref) USING (condition)""")


def marked(m):
    ref = m.spark.createDataFrame([("click", "h0"), ("view", "h1"), ("purchase", "h2"), ("signup", "h0")],
                                  "condition string, reference_hash string")
    return runs.one_code_version(event_runs(m), ref)


@query("one_code_version", "SELECT run_id, condition, gene FROM e_marked WHERE drop_reason IS NULL")
def _(m):
    return marked(m).filter("drop_reason IS NULL").select("run_id", "condition", "gene")


@query("exclusion_report", "SELECT condition, coalesce(drop_reason, 'kept') reason, count(*) n FROM e_marked GROUP BY 1, 2")
def _(m):
    return runs.exclusion_report(marked(m))


@query("work_list", """
SELECT condition, c_custkey gene FROM customer, (SELECT unnest(['click', 'view', 'purchase', 'signup']) condition)
WHERE (condition, c_custkey) NOT IN (SELECT (condition, gene) FROM e_runs WHERE status = 'COMPLETED' AND code_hash = 'h1')""")
def _(m):
    genes = m.table("customer").select(F.col("c_custkey").alias("gene"))
    return runs.work_list(genes, ["click", "view", "purchase", "signup"], event_runs(m), current())


@query("stale_counts", """
SELECT condition, count(*) FILTER (code_hash = 'h1') n_current, count(*) FILTER (code_hash <> 'h1') n_stale
FROM e_runs WHERE status = 'COMPLETED' GROUP BY 1""")
def _(m):
    return runs.stale_counts(event_runs(m), current())


@query("run_status", "SELECT condition, status, count(*) n FROM e_runs GROUP BY 1, 2")
def _(m):
    return event_runs(m).groupBy("condition", "status").agg(F.count("*").alias("n"))


@query("scorable_runs", """
SELECT run_id FROM e_runs WHERE status = 'COMPLETED' AND NOT abstained AND property IS NOT NULL AND model <> 'm0'
  AND run_id NOT IN (SELECT doc_id FROM labels)""")
def _(m):
    scored = m.table("labels").select(F.col("doc_id").alias("run_id"))
    return runs.scorable_runs(event_runs(m), "m0", scored).select("run_id")


@query("validity_by_condition", """
SELECT condition, count(*) n, round(avg(n_in_table / CAST(nullif(n_valid, 0) AS DOUBLE)), 6) mean_frac_in_table,
  round(avg(n_valid - n_in_table), 6) mean_outside_table, round(avg(n_invalid), 6) mean_invalid, round(avg(n_valid), 6) mean_valid
FROM e_runs GROUP BY 1""")
def _(m):
    r = event_runs(m).withColumn("frac_in_table", F.when(F.col("n_valid") > 0, F.col("n_in_table") / F.col("n_valid"))) \
                     .withColumn("n_outside_table", F.col("n_valid") - F.col("n_in_table"))
    return rounded(runs.validity_by_condition(r))


@query("validity_values", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, CAST({c} AS BIGINT) AS value, count(*) n_genes FROM e_runs GROUP BY 2" for c in ("n_valid", "n_invalid", "n_duplicate")))
def _(m):
    return runs.validity_values(event_runs(m))


@query("validity_state", """
SELECT CASE WHEN n_valid = 0 THEN 'none' WHEN n_invalid = 0 THEN 'all' ELSE 'some' END state, count(*) n_genes,
  CAST(sum(n_valid) AS BIGINT) valid, CAST(sum(n_invalid) AS BIGINT) invalid, CAST(sum(n_duplicate) AS BIGINT) duplicate
FROM e_runs GROUP BY 1""")
def _(m):
    return runs.validity_state(event_runs(m))


@query("noise_floor", """
SELECT condition, count(*) n_repeats, round(min(s), 6) lowest, round(max(s), 6) highest, round(max(s) - min(s), 6) spread
FROM (SELECT condition, repeat_, avg(score) s FROM e_runs GROUP BY 1, 2) GROUP BY 1""")
def _(m):
    return rounded(runs.noise_floor(event_runs(m)))


@query("cost_summary", """
SELECT round(quantile_cont(score, 0.5), 6) median_latency, round(quantile_cont(score, 0.9), 6) p90_latency,
  round(avg(score), 6) mean_latency,
  round(((SELECT count(*) FROM customer) - count(DISTINCT gene)) * quantile_cont(score, 0.5) / 3600, 6) remaining_hours
FROM e_runs WHERE status = 'COMPLETED'""")
def _(m):
    from enrichspark.functions.ordering import quantiles
    done = event_runs(m).filter("status = 'COMPLETED'")
    total = m.table("customer").agg(F.count("*").alias("n")).scalar()
    q = quantiles(done, "score", {"median_latency": 0.5, "p90_latency": 0.9})
    q = q.agg(F.struct(F.max("median_latency").alias("median_latency"), F.max("p90_latency").alias("p90_latency"))).scalar()
    s = done.agg(F.avg("score").alias("mean_latency"), F.count_distinct("gene").alias("_g")).withColumn("_q", q).select("*", "_q.*")
    return rounded(s.withColumn("remaining_hours", (total - F.col("_g")) * F.col("median_latency") / 3600).drop("_q", "_g"))


# -- verdicts
fragment("l_sample", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'grounded' ELSE 'ungrounded' END condition, doc_id AS index, quality = 1 is_positive,
  CASE WHEN toxic = 1 THEN 'applies' WHEN doc_id % 5 = 0 THEN 'partial' WHEN doc_id % 5 = 1 THEN 'applies'
       WHEN doc_id % 5 = 2 THEN 'insufficient_information' WHEN doc_id % 5 = 3 THEN 'does_not_apply' END verdict FROM labels""")


def verdicts(m):
    d = F.col("doc_id") % 5
    return m.table("labels").select(
        F.when(F.col("doc_id") % 2 == 0, "grounded").otherwise("ungrounded").alias("condition"), F.col("doc_id").alias("index"),
        (F.col("quality") == 1).alias("is_positive"),
        F.when(F.col("toxic") == 1, "applies").when(d == 0, "partial").when(d == 1, "applies")
        .when(d == 2, "insufficient_information").when(d == 3, "does_not_apply").alias("verdict"))


fragment("l_disc", """
SELECT condition, coalesce(avg(s) FILTER (is_positive), 0) coverage, coalesce(avg(s) FILTER (NOT is_positive), 0) leakage,
  coalesce(avg(h) FILTER (is_positive), 0) coverage_weighted, coalesce(avg(h) FILTER (NOT is_positive), 0) leakage_weighted,
  avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0.0 END) insufficient_rate, count(*) - count(verdict) n_missing,
  count(s) FILTER (is_positive) n_scored_positive, count(s) FILTER (NOT is_positive) n_scored_negative FROM (
  SELECT *, CASE verdict WHEN 'applies' THEN 1.0 WHEN 'partial' THEN 0.0 WHEN 'does_not_apply' THEN 0.0 END s,
    CASE verdict WHEN 'applies' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'does_not_apply' THEN 0.0 END h FROM l_sample) GROUP BY 1""")


def disc(m):
    v = verdicts(m)
    return runs.discrimination(v.drop("verdict"), v.filter("verdict IS NOT NULL").select("condition", "index", "verdict"))


@query("discrimination", """
SELECT condition, round(coverage, 6) coverage, round(leakage, 6) leakage, round(coverage_weighted, 6) coverage_weighted,
  round(leakage_weighted, 6) leakage_weighted, round(insufficient_rate, 6) insufficient_rate, n_missing, n_scored_positive,
  n_scored_negative, round(coverage - leakage, 6) j, round(coverage_weighted - leakage_weighted, 6) j_weighted FROM l_disc""")
def _(m):
    return rounded(disc(m))


@query("grounding_effect", """
SELECT round(max(CASE WHEN condition = 'grounded' THEN coverage - leakage END)
  - max(CASE WHEN condition = 'ungrounded' THEN coverage - leakage END), 6) grounding_effect FROM l_disc""")
def _(m):
    return rounded(runs.grounding_effect(disc(m)))


@query("term_match_score", """
SELECT round(avg(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END) FILTER (quality = 1 AND w IS NOT NULL), 6) real_score,
  round(avg(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END) FILTER (quality = 0 AND w IS NOT NULL), 6) background_score,
  round(avg(w) FILTER (quality = 1), 6) real_weighted, round(avg(w) FILTER (quality = 0), 6) background_weighted,
  count(w) FILTER (quality = 1) n_real, count(w) FILTER (quality = 0) n_background
FROM (SELECT quality, CASE WHEN toxic = 1 THEN 1.0 WHEN doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 3 = 1 THEN 0.0 END w FROM labels)""")
def _(m):
    d = F.col("doc_id") % 3
    judged = m.table("labels").select((F.col("quality") == 1).alias("is_real"), F.when(F.col("toxic") == 1, "match")
                                      .when(d == 0, "partial").when(d == 1, "no_match").alias("verdict"))
    return rounded(runs.term_match_score(judged))


# -- coverage
fragment("c_universe", """
SELECT c_custkey gene, c_acctbal breadth, coalesce(n, 0) n_direct_terms, top f1_top1,
  CASE WHEN c_nationkey > 0 THEN 'F' || c_nationkey END family, c_custkey % 3 <> 0 AND c_acctbal > -500 done,
  c_custkey % 7 n_significant, least(c_custkey % 7, coalesce(n, 0) % 4) match_terms, coalesce(top, 0) / 1000000 score
FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, max(o_totalprice) top FROM orders GROUP BY 1) ON o_custkey = c_custkey""")


def universe(m):
    o = m.table("orders").groupBy(F.col("o_custkey").alias("gene")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("f1_top1"))
    key = F.col("gene")
    return (m.table("customer").withColumnRenamed("c_custkey", "gene").join(o, "gene", "left").select(
        "gene", F.col("c_acctbal").alias("breadth"), F.coalesce("n", F.lit(0)).alias("n_direct_terms"), "f1_top1",
        F.when(F.col("c_nationkey") > 0, F.concat(F.lit("F"), "c_nationkey")).alias("family"),
        ((key % 3 != 0) & (F.col("c_acctbal") > -500)).alias("done"), (key % 7).alias("n_significant"),
        F.least(key % 7, F.coalesce("n", F.lit(0)) % 4).alias("match_terms"),
        (F.coalesce("f1_top1", F.lit(0.0)) / 1000000).alias("score")))


@query("scoreable_universe", """
SELECT gene, breadth, n_direct_terms, family, CAST(CASE WHEN n_significant > 0 THEN CASE WHEN match_terms > 0 THEN 1 ELSE 0 END END AS BIGINT) any_match
FROM c_universe""")
def _(m):
    any_match = F.when(F.col("n_significant") > 0, F.when(F.col("match_terms") > 0, 1).otherwise(0))
    return rounded(universe(m).select("gene", "breadth", "n_direct_terms", "family", any_match.alias("any_match")))


@query("coverage_by_decile", """
SELECT CAST(decile AS BIGINT) decile, count(*) n_universe, count(*) FILTER (done) n_done, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 6) pct_done
FROM (SELECT done, greatest(1, ceil((row_number() OVER (ORDER BY gene) - 1) * 10 / CAST(count(*) OVER () - 1 AS DOUBLE))) decile FROM c_universe)
GROUP BY 1""")
def _(m):
    rows = coverage.position_deciles(universe(m).withColumn("position", F.col("gene")), "position")
    return rounded(coverage.coverage_by(rows, F.col("decile"), "decile"))


@query("coverage_by_property", """
WITH e AS (SELECT quantile_cont(breadth, 0.2) a, quantile_cont(breadth, 0.4) b, quantile_cont(breadth, 0.6) c, quantile_cont(breadth, 0.8) d FROM c_universe)
SELECT CAST(CASE WHEN breadth <= a THEN 0 WHEN breadth <= b THEN 1 WHEN breadth <= c THEN 2 WHEN breadth <= d THEN 3 ELSE 4 END AS BIGINT) AS bin,
  count(*) n_universe, count(*) FILTER (done) n_done, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 6) pct_done FROM c_universe, e GROUP BY 1""")
def _(m):
    return rounded(coverage.property_bins(universe(m), "breadth"))


@query("coverage_by_family", """
WITH top AS (SELECT family FROM c_universe WHERE family IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, family LIMIT 10)
SELECT CASE WHEN family IS NULL THEN '(no family)' WHEN family IN (SELECT family FROM top) THEN family ELSE '(other families)' END family_group,
  count(*) n_universe, count(*) FILTER (done) n_done, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 6) pct_done FROM c_universe GROUP BY 1""")
def _(m):
    rows = coverage.top_families(universe(m), "family")
    return rounded(coverage.coverage_by(rows, F.col("family_group"), "family_group"))


@query("mean_differences", " UNION ALL ".join(f"""
SELECT '{p}' property, count({p}) FILTER (done) n_done, count({p}) FILTER (NOT done) n_missing,
  round(avg({p}) FILTER (done), 4) mean_done, round(avg({p}) FILTER (NOT done), 4) mean_missing,
  round((avg({p}) FILTER (done) - avg({p}) FILTER (NOT done)) / sqrt((var_samp({p}) FILTER (done) + var_samp({p}) FILTER (NOT done)) / 2), 4) smd
FROM c_universe""" for p in ("breadth", "n_direct_terms", "f1_top1")))
def _(m):
    return rounded(coverage.mean_differences(universe(m), ["breadth", "n_direct_terms", "f1_top1"]), 4)


@query("ks_two_sample", """
WITH RECURSIVE s AS (SELECT CAST(max(abs(a * nb - b * na)) AS BIGINT) gap, any_value(na) n, any_value(nb) m FROM (
  SELECT sum(count(*) FILTER (done)) OVER (ORDER BY breadth) a, sum(count(*) FILTER (NOT done)) OVER (ORDER BY breadth) b,
    (SELECT count(*) FROM c_universe WHERE done) na, (SELECT count(*) FROM c_universe WHERE NOT done) nb
  FROM c_universe GROUP BY breadth)),
walk AS (
  SELECT CAST(0 AS BIGINT) t, n, m, gap, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) f, 0.0::DOUBLE p FROM s
  UNION ALL SELECT t + 1, n, m, gap,
    list_transform(range(n + 1), lambda i: CASE WHEN abs(i * m - (t + 1 - i) * n) < gap THEN g[i + 1] ELSE 0.0 END),
    p + list_sum(list_transform(range(n + 1), lambda i: CASE WHEN abs(i * m - (t + 1 - i) * n) < gap THEN 0.0 ELSE g[i + 1] END))
  FROM (SELECT *, list_transform(range(n + 1), lambda i: (CASE WHEN i > 0 THEN f[i] * (n - i + 1) ELSE 0.0 END
      + f[i + 1] * greatest(m - (t - i), 0)) / (n + m - t)) g FROM walk WHERE t < n + m))
SELECT round(gap / (CAST(n AS DOUBLE) * m), 6) statistic, n n_done, m n_missing, round(least(1.0, p), 6) p FROM walk WHERE t = n + m""")
def _(m):
    return rounded(coverage.ks_two_sample(universe(m), "breadth"))


@query("group_difference", f"""
WITH b AS ({boot_sql('SELECT done, gene, breadth FROM c_universe', 'done', 'breadth', N_GROUP_BOOT)}),
d AS (SELECT boot, max(CASE WHEN done THEN mean END) - max(CASE WHEN NOT done THEN mean END) x FROM b GROUP BY 1)
SELECT count(*) FILTER (done) n_true, count(*) FILTER (NOT done) n_false, round(avg(breadth) FILTER (done), 4) mean_true,
  round(avg(breadth) FILTER (NOT done), 4) mean_false, round((SELECT quantile_cont(x, 0.025) FROM d), 4) ci_lo,
  round((SELECT quantile_cont(x, 0.975) FROM d), 4) ci_hi, round(avg(breadth) FILTER (done) - avg(breadth) FILTER (NOT done), 4) difference
FROM c_universe""")
def _(m):
    return rounded(compare.group_difference(universe(m), "done", "breadth", N_GROUP_BOOT), 4)


@query("reference_check", """
SELECT round(avg(breadth) FILTER (done), 4) breadth_done, round(avg(breadth) FILTER (NOT done), 4) breadth_missing,
  round(sum(match_terms) FILTER (done) / sum(n_significant) FILTER (done), 4) per_term_done,
  round(sum(match_terms) FILTER (NOT done) / sum(n_significant) FILTER (NOT done), 4) per_term_missing FROM c_universe""")
def _(m):
    return rounded(coverage.reference_check(universe(m), ["breadth"], "match_terms", "n_significant"), 4)


fragment("c_strata", """
SELECT *, (CASE WHEN breadth < b1 THEN 0 WHEN breadth < b2 THEN 1 WHEN breadth < b3 THEN 2 WHEN breadth < b4 THEN 3 ELSE 4 END) * 10
  + (CASE WHEN n_direct_terms < a1 THEN 0 WHEN n_direct_terms < a2 THEN 1 ELSE 2 END) stratum
FROM c_universe, (SELECT quantile_cont(breadth, 0.2) b1, quantile_cont(breadth, 0.4) b2, quantile_cont(breadth, 0.6) b3,
  quantile_cont(breadth, 0.8) b4, quantile_cont(n_direct_terms, 1.0/3) a1, quantile_cont(n_direct_terms, 2.0/3) a2 FROM c_universe)""")
fragment("c_weights", """
SELECT stratum, count(*) n_pop, count(*) FILTER (done) n_done, count(*) / nullif(CAST(count(*) FILTER (done) AS DOUBLE), 0) weight
FROM c_strata GROUP BY 1""")


def stratified(m):
    u = universe(m)
    return coverage.strata(u, u, "breadth", 5, "n_direct_terms", 3)


@query("stratum_weights", """
SELECT CAST(stratum AS BIGINT) stratum, n_pop, n_done, round(weight, 6) weight FROM c_weights""")
def _(m):
    s = stratified(m)
    return rounded(coverage.stratum_weights(s, s.filter("done")))


@query("post_stratify", """
SELECT round(avg(score), 6) score_raw, round(sum(weight * score) / sum(weight), 6) score_weighted,
  round(sum(weight) * sum(weight) / sum(weight * weight), 4) kish_n, round(max(weight), 6) max_weight, count(*) n_done,
  (SELECT count(*) FROM c_weights) n_strata, (SELECT count(*) FROM c_weights WHERE n_done < 20) n_thin_strata,
  round((SELECT sum(CASE WHEN n_done = 0 THEN n_pop ELSE 0 END) / sum(n_pop) FROM c_weights), 6) uncovered_share
FROM c_strata JOIN (SELECT stratum, weight FROM c_weights) USING (stratum) WHERE done""")
def _(m):
    s = stratified(m)
    r = coverage.post_stratify(s, s.filter("done"), ["score"])
    return rounded(r.withColumn("kish_n", F.round("kish_n", 4)))


@query("stratified_interval", f"""
WITH p AS ({boot_sql('SELECT stratum, gene, score FROM c_strata WHERE done', 'stratum', 'score', N_STRATUM_BOOT)}),
b AS (SELECT boot, sum(n_pop * mean) / sum(n_pop) x FROM p JOIN c_weights USING (stratum) WHERE mean IS NOT NULL GROUP BY 1)
SELECT round(quantile_cont(x, 0.025), 6) ci_lo, round(quantile_cont(x, 0.975), 6) ci_hi FROM b""")
def _(m):
    s = stratified(m)
    return rounded(coverage.stratified_interval(s, s.filter("done"), "score", N_STRATUM_BOOT))
