"""Every registered query against its SQL, and the shape of its plan."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import entry
from geoscore.workload.oracle import ORACLE
from geoscore.workload.queries import QUERIES

TABLES = ("lineitem", "orders")
# Built on fitted models; their own SQL counterparts check coverage and agreement.
WITHOUT_SQL = {
    "boosted_a_oof",
    "boosted_b_oof",
    "forest_oof",
    "ensemble_oof",
    "oof_model_comparison",
    "feature_importance",
    "batch_score",
    "stream_score",
    "scored_heat_layer",
}
MODEL_QUERIES = WITHOUT_SQL | {
    "oof_coverage",
    "feature_importance_summary",
    "batch_score_coverage",
    "stream_batch_agreement",
    "model_roundtrip",
    "scored_heat_totals",
    "rescored_table",
    "planted_out_of_fold",
    "planted_comparison",
    "stream_checked",
    "node_table_scores",
    "staged_losses",
    "same_trees",
    "interrupted_save",
    "stream_two_outputs",
    "permutation_ranks",
}
# Queries over the scored points that must read their source once, eager jobs included.
ONE_SCAN = (
    "roc_auc",
    "average_precision",
    "rank_metrics_quantised",
    "rank_metrics_by_state",
    "metrics_record",
    "model_comparison",
    "threshold_curve",
    "threshold_curve_by_state",
    "dataset_profile",
    "json_typed_quarantine",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def test_registry_is_complete():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    ours = canonical(QUERIES[name](spark, sf_dir).toPandas())
    theirs = canonical(con.execute(ORACLE[name]).fetchdf())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_model_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_plan_shape(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan
    # Rows reach a single task only after they were aggregated.
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange SinglePartition" in line:
            if "Project" in below:
                below = plan.splitlines()[plan.splitlines().index(below) + 1]
            assert "Aggregate" in below or "Scan parquet" in below or "Range" in below, below


@pytest.mark.parametrize("name", ONE_SCAN)
def test_source_is_read_once(spark, sf_dir, name, monkeypatch):
    """Counts scans of the given tables in the query's plan and in all that it stores on the way."""
    scans = []

    def count(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        scans.append(sum("FileScan parquet" in line and sf_dir in line for line in plan.splitlines()))

    from geoscore.operators import profile, ranking
    from geoscore.sources import storage

    def stored(df, *args, **kwargs):
        count(df)
        return storage.store(df, *args, **kwargs)

    monkeypatch.setattr(ranking, "store", stored)
    monkeypatch.setattr(profile, "store", stored)
    count(QUERIES[name](spark, sf_dir))
    assert sum(scans) == 1


def test_scan_reads_only_what_a_query_needs(spark, sf_dir):
    plan = QUERIES["class_balance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.risk_level for r in rows} == {"LOW", "MODERATE", "HIGH", "CRITICAL"}
