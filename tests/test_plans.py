"""Physical plans have the shape the design relies on."""

import pytest

from conftest import SF_SMALL
from quarry.plans.queries_report import window_counts
from quarry.plans.registry import load_all

REG = load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_n_uses_window_group_limit(spark):
    plan = _plan(REG["highlights"].build(spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_single_query_topk_is_take_ordered(spark):
    plan = _plan(REG["vector_topk"].build(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_ticket_join_is_a_hash_join_on_nodes(spark):
    plan = _plan(REG["ticket_files"].build(spark, SF_SMALL))
    assert "BroadcastHashJoin [level" in plan
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["statistics", "highlights", "ticket_window_counts"])
def test_window_aggregates_form_no_pairs(spark, name):
    """Rows are reduced to units and nodes before they meet windows."""
    df = REG[name].build(spark, SF_SMALL)
    plan = _final_plan(df)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "unit#" in plan


def test_native_profiles_stay_in_the_jvm(spark):
    for name in ("markdown_profile", "generic_profile", "binary_profile", "notebook_profile"):
        plan = _plan(REG[name].build(spark, SF_SMALL))
        assert "MapInArrow" not in plan and "PythonUDF" not in plan, name


def test_scan_prunes_columns(spark):
    plan = _plan(REG["breakdown_by_type"].build(spark, SF_SMALL))
    # the profile columns are never read for an inventory aggregate
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "lang" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_window_counts_are_the_same_without_broadcasts(spark, monkeypatch):
    from quarry.operators import dyadic
    a = sorted(window_counts(spark, SF_SMALL).collect())
    monkeypatch.setattr(dyadic, "BROADCAST_BYTES", 0)
    b = sorted(window_counts(spark, SF_SMALL).collect())
    assert a == b and len(a) == 100


REPORTS = ["breakdown_note", "breakdown_code", "summary_text", "files_indexed", "task_report",
           "task_result_flat", "run_totals", "report_files", "report_conformance"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_read_one_written_parse(spark, name):
    """Every branch of a report reads the written profiles; none parses again."""
    plan = _plan(REG[name].build(spark, SF_SMALL))
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    assert "doc_id:bigint,text:string" not in plan


@pytest.mark.parametrize("name", ["ticket_validation", "task_errors", "report_violations"])
def test_ticket_operators_touch_no_file(spark, name):
    plan = _plan(REG[name].build(spark, SF_SMALL))
    assert "documents.parquet" not in plan and "conversations.parquet" in plan
