"""Registered queries against their SQL in a second engine, and the shape of the plans."""

import math
import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry_module
from erascope.operators.counts import count_pairs_with_target
from erascope.operators.projection import target_code
from erascope.operators.scores import era_scores, global_scores
from erascope.workloads.tables import EVENT_FEATURES, LINE_FEATURES, event_panel, line_panel

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# Runs in seconds; set ERASCOPE_ALL=1 for every registered query.
QUICK = [
    "s4_feature_sets", "s9_selected_sink", "s11_run_parameters", "p7_panel_projection",
    "p9_type_normalisation", "j4_panel_build", "a5_check_report", "a10_pair_target_counts_tiled", "a13_gram",
    "w1_average_rank_hot", "w8_ensemble", "w9_global_scores", "m4_era_scores", "m11_payoff_vector",
    "f10_feature_ranking", "f12_linear_attributions", "l7_evaluate_split", "l14_live_predictions",
    "u1_user_score_arrays", "u1_user_score_meta", "u1_user_score_meta_arrays", "u1_user_score_compounded", "u2_user_model",
    "l2_ols_predict_wide", "l8_refit_run", "s1_panel_scan", "s5_ranked_sets", "f9_greedy_steps", "r6_metric_bundle",
    "l4_tree_table", "f13_normal_equations", "p15_subsample",
]
NAMES = sorted(set(entry_module.queries()) - set(entry_module.LLM_QUERIES)) if os.environ.get("ERASCOPE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f":
            return f"{float(v):.9f}"
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SMALL).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_registry():
    names = set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= names
    names -= set(entry_module.LLM_QUERIES)
    assert names - set(entry_module.oracle_sql()) == {"f13_t_value_elimination", "l4_boosted_trees"}


def test_flagship(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["era", "n", "corr", "mmc", "payoff"] and got.count() == 30


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_plan_shuffles_once(spark):
    plan = executed(era_scores(event_panel(spark, SMALL), "preds_0", strategy="window"))
    assert plan.count("Exchange hashpartitioning(era") == 1 and plan.count("Exchange") == 1
    assert "props" not in plan.split("ReadSchema")[-1]


def test_no_plan_crosses_tables_or_collects_into_one_partition(spark):
    frames = [
        era_scores(line_panel(spark, SMALL), "preds_0", strategy="prefix"),
        global_scores(line_panel(spark, SMALL), "preds_0"),
        count_pairs_with_target(line_panel(spark, SMALL), LINE_FEATURES, target_code("target")),
        count_pairs_with_target(event_panel(spark, SMALL), EVENT_FEATURES, target_code("target"), method="tiles"),
    ]
    for df in frames:
        plan = executed(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        # a single partition only holds aggregate rows
        for line in plan.splitlines():
            if "Exchange SinglePartition" in line:
                following = plan.splitlines()[plan.splitlines().index(line) + 1]
                assert "HashAggregate" in following or "ObjectHashAggregate" in following
