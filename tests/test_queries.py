"""Registered queries: invariants on the model tables, and agreement with their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from enrichspark.plans.model import model
from tools.check import norm

SF = "/root/testdata/sf0.001"

QUICK = ["expression_summary", "item_features", "over_representation", "corrected_stats", "score_rankings", "ceilings", "transfer_rank",
         "classify_terms", "choose_donors", "latest_run", "post_stratify", "resolve_predictions", "read_obo_edges", "benjamini_hochberg"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)


def test_every_query_has_sql():
    from enrichspark.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fold_never_exceeds_its_ceiling(spark):
    m = model(spark, SF)
    assert m.enriched.filter(F.col("fold") > F.col("n_background") / F.col("query_size") + 1e-9).isEmpty()


def test_assigned_terms_are_reachable(spark):
    rows = model(spark, SF).tested  # both units
    assert rows.count() > 0
    assert rows.filter((F.col("p_gscs") < 0.05) & ~F.col("reachable")).isEmpty()


def test_root_carries_no_information(spark):
    m = model(spark, SF)
    assert m.ic.filter("term = 1").first()["ic"] == 0.0


def test_stale_table_is_refused(spark, tmp_path):
    from enrichspark.sources.tables import read_keyed, write_keyed
    write_keyed(spark.range(3).toDF("x"), str(tmp_path / "b"), {"depth": 3})
    assert read_keyed(spark, str(tmp_path / "b"), {"depth": 3}).count() == 3
    with pytest.raises(ValueError):
        read_keyed(spark, str(tmp_path / "b"), {"depth": 4})


def test_shuffled_baseline_ranks_once(spark, con):
    """The rankings and donors under every reading of the borrowed predictions come from written tables."""
    assert "Aggregate" not in model(spark, SF).rates._jdf.queryExecution().optimizedPlan().toString()
    df = entry.queries()["shuffled_baseline"](spark, SF)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    cur = con.execute(entry.oracle_sql()["shuffled_baseline"])
    cols = [d[0] for d in cur.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)
