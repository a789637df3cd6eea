"""Bookkeeping over a run table: runs(run_id, condition, gene, status, code_hash, start_time, ...).

A gene or condition may hold any share of the runs, so choices per key are aggregates, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The last started run of each key."""
    order = F.struct("start_time", "run_id")
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in keys]), order).alias("_r")) \
               .select(*keys, "_r.*")


def best_run(runs: DataFrame, current: Column, keys: list[str]) -> DataFrame:
    """Completed before not, current code before older, then the latest."""
    order = F.struct((F.col("status") == "COMPLETED").alias("done"), current.alias("current"), "start_time", "run_id")
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in keys]), order).alias("_r")) \
               .select(*keys, "_r.*")


def select_runs(runs: DataFrame, status: str | None = None, split: str | None = None,
                condition: str | None = None) -> DataFrame:
    """Runs matching the given tags, to be read in start order."""
    for name, value in (("status", status), ("split", split), ("condition", condition)):
        if value is not None:
            runs = runs.filter(F.col(name) == value)
    return runs


def one_code_version(runs: DataFrame, reference: DataFrame, test_split: str = "test") -> DataFrame:
    """Add drop_reason: wrong code version for the condition, or an unfrozen run on the test split; null is kept.

    reference is a small table (condition, reference_hash).
    """
    why = (F.when(~F.col("code_hash").eqNullSafe(F.col("reference_hash")), "other_code")
           .when(F.col("unfrozen") & (F.col("split") == test_split), "unfrozen"))
    return runs.join(reference, "condition", "left").withColumn("drop_reason", why).drop("reference_hash")


def exclusion_report(marked: DataFrame) -> DataFrame:
    return marked.groupBy("condition", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def work_list(genes: DataFrame, conditions: list[str], runs: DataFrame, current: Column) -> DataFrame:
    """(condition, gene) still to do: no completed run under the current code."""
    todo = genes.select("gene").withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    done = runs.filter((F.col("status") == "COMPLETED") & current).select("condition", "gene").distinct()
    return todo.join(done, ["condition", "gene"], "left_anti")


def stale_counts(runs: DataFrame, current: Column) -> DataFrame:
    """Completed runs per condition under current and under older code."""
    return (runs.filter("status = 'COMPLETED'").groupBy("condition")
            .agg(F.count_if(current).alias("n_current"), F.count_if(~current).alias("n_stale")))


def missing_reason(genes: DataFrame, best: DataFrame, current: Column) -> DataFrame:
    """Why each gene has no finished run, or 'done'."""
    b = best.withColumn("_current", current)
    s = F.col("status")
    reason = (F.when(s.isNull(), "no run yet").when((s == "COMPLETED") & F.col("_current"), "done")
              .when(s == "COMPLETED", "completed under older code").when(s == "FAILED_BLINDING", "failed blinding")
              .when(s == "FAILED_PARSE", "failed parse").when(s == "UNFINISHED", "not finished")
              .otherwise(F.concat(F.lit("status "), s)))
    return genes.join(b, "gene", "left").withColumn("reason", reason).drop("_current")


def scorable_runs(runs: DataFrame, judge: str, scored: DataFrame) -> DataFrame:
    """Completed runs that did not abstain, have a property, come from another model and were not scored before."""
    return (runs.filter((F.col("status") == "COMPLETED") & ~F.col("abstained") & F.col("property").isNotNull()
                        & (F.col("model") != judge)).join(scored.select("run_id"), "run_id", "left_anti"))


def validity_by_condition(runs: DataFrame) -> DataFrame:
    """Mean output validity of each condition; runs without valid answers do not enter frac_in_table."""
    return runs.groupBy("condition").agg(
        F.count("*").alias("n"), F.avg("frac_in_table").alias("mean_frac_in_table"),
        F.avg("n_outside_table").alias("mean_outside_table"), F.avg("n_invalid").alias("mean_invalid"),
        F.avg("n_valid").alias("mean_valid"))


def validity_state(runs: DataFrame) -> DataFrame:
    """Genes with all, some or no valid answers, and the answers behind them."""
    state = (F.when(F.col("n_valid") == 0, "none").when(F.col("n_invalid") == 0, "all").otherwise("some"))
    return runs.groupBy(state.alias("state")).agg(
        F.count("*").alias("n_genes"), F.sum("n_valid").alias("valid"), F.sum("n_invalid").alias("invalid"),
        F.sum("n_duplicate").alias("duplicate"))


def validity_values(runs: DataFrame, measures: tuple[str, ...] = ("n_valid", "n_invalid", "n_duplicate")) -> DataFrame:
    """(measure, value, n_genes): how many genes have each number of valid, invalid and repeated answers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in measures])
    return runs.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.value").agg(F.count("*").alias("n_genes"))


def noise_floor(repeats: DataFrame) -> DataFrame:
    """Mean score per repeat of each condition and the spread between repeats."""
    per = repeats.groupBy("condition", "repeat").agg(F.avg("score").alias("mean"))
    return per.groupBy("condition").agg(F.count("*").alias("n_repeats"), F.min("mean").alias("lowest"),
                                        F.max("mean").alias("highest"), (F.max("mean") - F.min("mean")).alias("spread"))


def discrimination(sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Coverage, leakage and their difference J per condition, strict and with partial counted half.

    sample is (condition, index, is_positive), verdicts (condition, index, verdict). insufficient_information
    leaves both sides; a missing verdict is treated the same and counted.
    """
    rows = sample.join(verdicts, ["condition", "index"], "left")
    v = F.col("verdict")
    strict = F.when(v == "applies", 1.0).when(v.isin("partial", "does_not_apply"), 0.0)
    half = F.when(v == "applies", 1.0).when(v == "partial", 0.5).when(v == "does_not_apply", 0.0)

    def rate(x, side):
        return F.coalesce(F.avg(F.when(side, x)), F.lit(0.0))
    pos, neg = F.col("is_positive"), ~F.col("is_positive")
    return (rows.groupBy("condition").agg(
        rate(strict, pos).alias("coverage"), rate(strict, neg).alias("leakage"),
        rate(half, pos).alias("coverage_weighted"), rate(half, neg).alias("leakage_weighted"),
        F.avg(F.when(strict.isNull(), 1.0).otherwise(0.0)).alias("insufficient_rate"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.count(F.when(pos, strict)).alias("n_scored_positive"), F.count(F.when(neg, strict)).alias("n_scored_negative"))
        .withColumn("j", F.col("coverage") - F.col("leakage"))
        .withColumn("j_weighted", F.col("coverage_weighted") - F.col("leakage_weighted")))


def grounding_effect(metrics: DataFrame) -> DataFrame:
    """J with definitions shown minus J without."""
    def j(condition):
        return F.max(F.when(F.col("condition") == condition, F.col("j")))
    return metrics.agg((j("grounded") - j("ungrounded")).alias("grounding_effect"))


def term_match_score(judged: DataFrame) -> DataFrame:
    """Share of real and of background terms judged a match, strict and with partial counted half."""
    v = F.col("verdict")
    w = F.when(v == "match", 1.0).when(v == "partial", 0.5).when(v == "no_match", 0.0)
    strict = F.when(w.isNotNull(), F.when(w == 1.0, 1.0).otherwise(0.0))
    real, back = F.col("is_real"), ~F.col("is_real")

    def rate(x, side):
        return F.coalesce(F.avg(F.when(side, x)), F.lit(0.0))
    return judged.agg(rate(strict, real).alias("real_score"), rate(strict, back).alias("background_score"),
                      rate(w, real).alias("real_weighted"), rate(w, back).alias("background_weighted"),
                      F.count(F.when(real, w)).alias("n_real"), F.count(F.when(back, w)).alias("n_background"))
