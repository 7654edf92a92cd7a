"""Scores, status, gate, first fix, graph on findings given as a table."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import compare, gate, graph, guidance, history, score

SCHEMA = "project_id string, stage int, path string, line_no int, sub_ord int, rule string, title string, severity string, category string"
SECRET, TOOL, APPROVAL = "Secret Exposure Risk", "Tool Permission Risk", "Human Approval Risk"
AUDIT, DATA, PROMPT = "Auditability Risk", "Data Exposure Risk", "Prompt Injection Risk"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        full = [(p, i, path, line, 0, "r", title, sev, cat) for i, (p, path, line, title, sev, cat) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)
    return make


def units(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "project_id string")


def test_scores(spark, table):
    rows = [("cap", "a", i, "t", "Critical", SECRET) for i in range(3)]
    rows += [("sum", "a", 1, "t", "critical", TOOL), ("sum", "a", 2, "t", "HIGH", "tool permission")]
    rows += [("odd", "a", 1, "t", "weird", TOOL), ("odd", "a", 2, "t", "Info", DATA)]
    got = {r.project_id: r for r in score.scored(score.facts(table(rows), units(spark, "cap", "sum", "odd", "none"))).collect()}
    assert got["cap"].score_secret_exposure == 100 and got["cap"].safety_score == 80
    assert got["sum"].score_tool_permission == 65
    assert (got["odd"].score_tool_permission, got["odd"].safety_score) == (0, 100)
    assert (got["none"].safety_score, got["none"].status) == (100, "Strong")


@pytest.mark.parametrize("risk,expected", [(32.5, 68), (33.5, 66), (0.0, 100), (150.0, 0), (31.5, 68), (40.5, 60), (5.75, 94)])
def test_half_even(spark, risk, expected):
    assert spark.range(1).select(score.safety(F.lit(risk)).alias("s")).collect()[0].s == expected


def test_status_bands(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 50, 51, 75, 76, 90, 91, 100)], "s int")
    got = [r.status for r in df.select(R.status_of(F.col("s")).alias("status"), "s").orderBy("s").collect()]
    assert got == ["Critical Risk"] * 2 + ["High Risk"] * 2 + ["Moderate Risk"] * 2 + ["Low Risk"] * 2 + ["Strong"] * 2


def test_gate_on_three_findings(spark, table):
    rows = [("p", "config.py", 4, "Hardcoded GEMINI_API_KEY detected", "Critical", SECRET),
            ("p", "tools.py", 10, "Risky function 'send_refund' detected", "High", TOOL),
            ("p", "tools.py", 10, "Missing approval gate for send_refund", "High", APPROVAL)]
    unit = score.facts(table(rows), units(spark, "p")).withColumn("safety_score", F.lit(42))
    got = {r.policy_id: r for r in gate.judge(gate.under_policies(unit, {"default": {}, "off": {
        "minimum_safety_score": 0, "block_on_critical": False, "block_on_secrets": False,
        "block_on_missing_approval": False, "block_on_unsafe_tools": False}})).withColumn("doc", gate.gate_document())
        .withColumn("json", gate.policy_json()).collect()}
    d = got["default"]
    assert d.decision == "BLOCK" and len(d.blockers) == 5 and d.gate_score == 0
    assert d.blockers[1] == "Critical findings are present (1)."
    assert d.doc.category_blocker_counts["secret_exposure"] == 1
    assert d.next_actions[0].startswith("Rotate") and len(d.next_actions) == 5
    assert '"decision" : "BLOCK"' in d.json
    assert (got["off"].decision, got["off"].gate_score) == ("REVIEW", 32)


def test_graph(spark, table):
    bare = [("p", "a.py", 1, "Risky function 'refund' detected", "Critical", TOOL), ("p", "a.py", 1, "x", "Critical", APPROVAL),
            ("p", "a.py", 1, "y", "High", AUDIT), ("q", "a.py", 1, "Risky function 'refund' detected", "Critical", TOOL),
            ("q", "a.py", 9, "Risky function 'refund' detected", "High", TOOL), ("q", "b.py", 1, "p", "Medium", PROMPT)]
    rows = table(bare)
    unit = score.facts(rows, units(spark, "p", "q"))
    edges = {}
    for r in graph.edges(rows, unit).collect():
        edges.setdefault(r.project_id, []).append((r.source, r.target, r.risk))
    assert sorted(edges["p"]) == [("agent", "refund", "critical"), ("user", "agent", "low")]
    assert sorted(edges["q"]) == sorted([
        ("user", "agent", "medium"), ("agent", "approval_refund", "low"), ("approval_refund", "refund", "critical"), ("refund", "audit_log", "low"),
        ("agent", "approval_refund", "low"), ("approval_refund", "refund", "high"), ("refund", "audit_log", "low")])
    nodes = {(r.project_id, r.id): r.label for r in graph.nodes(rows, unit).collect()}
    assert {i for p, i in nodes if p == "p"} == {"user", "agent", "refund"}
    assert {i for p, i in nodes if p == "q"} == {"user", "agent", "refund", "approval_refund", "audit_log"}
    assert nodes[("q", "approval_refund")] == "Approval Gate: refund"


def test_first_fix(spark, table):
    rows = table([("p", "a", 1, "t1", "Medium", TOOL), ("p", "a", 2, "t2", "High", DATA), ("p", "a", 3, "t3", "Low", SECRET)])
    unit = score.scored(score.facts(rows, units(spark, "p")))
    judged = gate.judge(gate.under_policies(unit, {"default": {}, "off": {"block_on_secrets": False}}))
    got = {r.policy_id: r.title for r in guidance.first_fix(rows, judged).collect()}
    assert got == {"default": "t3", "off": "t2"}


def test_checklist_defaults_and_plan(spark, table):
    rows = table([("low", "a", 1, "t", "Low", AUDIT), ("hi", "a", 1, "Risky function 'x'", "High", TOOL)]).withColumn("suggested_fix", F.lit("do it"))
    unit = score.facts(rows, units(spark, "low", "hi", "none"))
    lists = guidance.checklist(rows, unit)
    got = {r.project_id: r.checklist for r in lists.collect()}
    assert len(got["none"]) == 3 and got["hi"][0] == "do it" and len(got["hi"]) == 2 and len(got["low"]) == 1
    plans = {r.project_id: r.plan for r in guidance.plan(rows, lists).collect()}
    assert plans["hi"] == ["Restrict risky tool calls to approved scopes."]
    assert plans["low"][0].startswith("Log every tool call") and plans["low"][0].endswith(".")


def test_compare_ids_or_not(spark):
    rows = [("b", "x_001", TOOL, "t", "a.py", 3, "High"), ("a", "x_002", TOOL, "t", "a.py", 3, "High"), ("a", "x_001", TOOL, "n", "a.py", 1, "Critical")]
    df = spark.createDataFrame(rows, "report_id string, id string, category string, title string, path string, line_no int, severity string")
    pairs = spark.createDataFrame([("k", "b", "a")], "pair_id string, before_id string, after_id string")
    kinds = lambda stable: sorted((r.change, r.title) for r in compare.changed(df, pairs, stable).collect())
    assert kinds(True) == [("new", "n")]
    assert kinds(False) == [("fixed", "t"), ("new", "n"), ("new", "t")]
    scores = spark.createDataFrame([("b", 50), ("a", 40)], "report_id string, safety_score int")
    m = compare.metrics(df, scores, pairs, True).collect()[0]
    assert (m.score_delta, m.verdict, m.fixed, m.added, m.critical_added) == (-10, "Security posture regressed", 0, 1, 1)


def test_history_order(spark):
    df = spark.createDataFrame([("1", None), ("2", "2024-01-02"), ("3", "2024-01-05")], "id string, c string").withColumn("created_at", F.to_timestamp("c"))
    assert [r.id for r in history.newest_first(df).collect()] == ["3", "2", "1"]
