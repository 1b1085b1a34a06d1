"""Physical plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest

from textward.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
PYTHON = {"tool_call_decisions", "agent_rate_limits", "agent_call_counters", "tool_call_log", "approval_queue",
          "access_control_log", "token_bucket", "file_findings", "file_texts", "tenant_keyword_rules", "tool_call_decisions_then"}
BATCH = [n for n in REGISTRY if not n.startswith("stream_")]


def plan(spark, name):
    return REGISTRY[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_python_only_where_expected(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(re.search("InPandas|InArrow|PythonUDTF|ArrowEvalPython", text)) == (name in PYTHON)
    assert "BatchEvalPython" not in text


def test_scans_read_only_needed_columns(spark):
    assert "ReadSchema: struct<text:string>" not in plan(spark, "audit_summary")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "audit_kpis"))
    assert all("props" not in s for s in schemas)
    docs = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "document_access"))
    assert all("text" not in s for s in docs)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in plan(spark, "agent_registry")


def test_detection_is_one_pass_without_shuffle_of_texts(spark):
    text = plan(spark, "inspection_results")
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert all("REPARTITION_BY_NUM" in line for line in exchanges)  # only the spread of a small file
    assert len(re.findall(r"\(\?imuU\)\\b\[A-Za-z0-9\._%\+\\-\]\+@", text)) <= 3  # once in the mask, twice in the spans


def test_filter_on_a_verdict_does_not_copy_the_detectors(spark):
    from textward.operators.inspect import verdicts
    from textward.plans import inputs

    df = verdicts(inputs.documents(spark, SF)).where("action = 'block' AND risk_score > 0.5")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("AKIA[0-9A-Z]{16}") == 1
